"""Scalar functions: Column in, Column out, all native expressions."""
