"""Queries over the given tables and composite pipelines."""
