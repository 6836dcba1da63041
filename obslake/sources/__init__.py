"""Sources of obslake."""
