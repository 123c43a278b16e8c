"""Readers: web archives, key-value text, topic files, run files."""
