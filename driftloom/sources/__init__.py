"""Readers, writers and row codecs."""
