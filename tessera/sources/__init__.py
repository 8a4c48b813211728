"""Readers, writers and the derived views every query starts from."""
