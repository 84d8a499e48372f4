"""DataFrame operators: lazy, no action inside unless the operator is a sink."""
