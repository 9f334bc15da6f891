"""See the package docstring of emberlog."""
