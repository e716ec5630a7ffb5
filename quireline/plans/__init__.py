"""Quireline plans."""
