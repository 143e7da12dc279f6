"""Joins and aggregations of stars."""
