"""Timed text from ordered recognition data, as DataFrame functions."""
