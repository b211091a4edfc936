"""Texts of the schema and query languages."""
