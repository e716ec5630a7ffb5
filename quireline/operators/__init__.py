"""Quireline operators."""
