"""Operators on vectors, indexes and metadata."""
