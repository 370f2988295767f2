"""Readers, writers, snapshots, logs and the catalog."""
