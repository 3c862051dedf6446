"""Registered queries: the operators wired to tables."""
