"""plans of the flow engine."""
