"""Scans of the raw feeds and sinks for the clean tables."""
