"""SQL that states each query a second time, for DuckDB, in the plainest form: one grouped table
per measure and full joins between them. It shares no code with the DataFrame side."""
