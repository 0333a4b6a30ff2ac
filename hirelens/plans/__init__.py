"""Registered queries: library operators over the given tables, each with its SQL twin."""
