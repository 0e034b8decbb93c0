"""sources of the trace engine."""
