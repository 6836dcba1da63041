"""Plans of obslake."""
