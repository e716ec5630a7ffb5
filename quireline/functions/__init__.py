"""Quireline functions."""
