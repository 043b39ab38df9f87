"""Incremental work over new files."""
