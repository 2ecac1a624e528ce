"""Graphs derived from relational tables, and the catalogue of registered queries with their SQL."""
