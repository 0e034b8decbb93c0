"""operators of the trace engine."""
