"""Query modules: each has QUERIES (name to callable of session and folder) and SQL (name to the DuckDB text)."""
