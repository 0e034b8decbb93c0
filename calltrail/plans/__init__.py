"""plans of the trace engine."""
