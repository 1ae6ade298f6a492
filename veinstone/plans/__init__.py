"""Registered queries: modules with QUERIES (name to callable) and SQL (name to DuckDB text)."""
