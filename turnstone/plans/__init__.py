"""Named queries: each applies operators to the given tables and has DuckDB text that must give the same rows."""
