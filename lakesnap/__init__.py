"""Snapshot-versioned lakehouse tables, their backup and restore, on Spark."""
