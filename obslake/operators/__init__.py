"""Operators of obslake."""
