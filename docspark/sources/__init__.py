"""Readers, writers and hooks for recognition engines."""
