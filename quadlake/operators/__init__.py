"""Operators over quads and statement tables."""
