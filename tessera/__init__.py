"""Tessera: fragment-memory analytics as declarative Spark plans."""
