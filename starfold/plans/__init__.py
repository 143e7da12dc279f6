"""Benchmark queries and the registry."""
