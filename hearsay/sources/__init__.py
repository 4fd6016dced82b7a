"""Readers, the post store and lookup tables."""
