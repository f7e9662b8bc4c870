"""Independent DuckDB statements for every registered query."""
