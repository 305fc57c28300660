"""Readers, validators and writers at the edges of the engine."""
