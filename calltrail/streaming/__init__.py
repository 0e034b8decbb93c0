"""streaming of the trace engine."""
