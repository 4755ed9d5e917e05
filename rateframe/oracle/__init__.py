"""DuckDB statements that state independently what each query must return."""
