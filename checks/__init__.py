"""Fixture tables and independent DuckDB oracles used by the entry file, the tests and the bench."""
