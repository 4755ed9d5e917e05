"""Readers, writers and the views that derive engine inputs from given tables."""
