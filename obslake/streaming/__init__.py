"""Streaming of obslake."""
