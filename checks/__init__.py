"""Inputs derived from the given tables, the registered queries and their oracle SQL."""
