"""See the module docstrings of this folder."""
