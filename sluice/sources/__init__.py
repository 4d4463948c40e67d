"""sources of the flow engine."""
