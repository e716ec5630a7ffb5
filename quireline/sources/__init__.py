"""Quireline sources."""
