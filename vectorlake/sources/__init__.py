"""Readers, writers and the collection store."""
