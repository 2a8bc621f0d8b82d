"""Graph-query-log and quad analytics as PySpark DataFrame jobs."""
