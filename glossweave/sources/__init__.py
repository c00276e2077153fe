"""Readers and job tables."""
