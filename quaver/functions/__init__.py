"""See the package docstring of quaver."""
