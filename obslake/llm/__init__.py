"""Operators on document texts; nothing outside this subpackage imports it."""
