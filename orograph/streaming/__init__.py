"""Operators with state over streams."""
