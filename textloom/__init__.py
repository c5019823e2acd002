"""Fuzzy dictionary matching and sequence analytics as Spark DataFrame operations."""
