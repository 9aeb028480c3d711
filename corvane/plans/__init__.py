"""Queries over the provided tables."""
