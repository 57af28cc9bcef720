"""Whole query plans: searches, and the registered queries with their SQL."""
