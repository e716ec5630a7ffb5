"""Quireline streaming."""
