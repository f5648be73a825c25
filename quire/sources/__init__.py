"""Readers and writers for the tables the engine consumes and produces."""
