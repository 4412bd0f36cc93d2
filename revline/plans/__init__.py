"""Whole plans: the review, reports as line rows, the registered queries and their DuckDB oracles."""
