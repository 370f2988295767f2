"""Streaming upkeep of collections."""
