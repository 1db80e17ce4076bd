"""Equivalent SQL for every registered query, run by DuckDB over the same parquet tables to check results."""
