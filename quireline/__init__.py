"""Quireline: document-structure analytics and corpus preparation on Spark DataFrames."""
