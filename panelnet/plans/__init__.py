"""Queries over the star-schema tables, and whole pipelines."""
