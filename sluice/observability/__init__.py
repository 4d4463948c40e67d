"""observability of the flow engine."""
