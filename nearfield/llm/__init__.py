"""Operators of large training-data pipelines. Nothing else in this library imports this subpackage."""
