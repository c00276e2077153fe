"""Operators over documents, divisions, segments and beads."""
