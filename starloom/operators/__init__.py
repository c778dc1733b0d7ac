"""Operators on the engine's relations."""
