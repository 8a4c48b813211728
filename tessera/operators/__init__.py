"""Relational operators: scopes, search, fusion, graph, analytics, maintenance."""
