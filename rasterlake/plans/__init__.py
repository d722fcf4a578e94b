"""Shared plan shapes: hot-key safe joins, ordered sums, fixtures and the query list."""
