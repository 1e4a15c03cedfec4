"""Pipelines, bindings to the given tables, and the query catalogue."""
