"""Functions of obslake."""
