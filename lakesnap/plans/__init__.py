"""Registered queries over the engine's operators."""
