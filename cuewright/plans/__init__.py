"""Whole queries and their registry."""
