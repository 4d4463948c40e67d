"""operators of the flow engine."""
