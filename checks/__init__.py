"""Independent DuckDB statements and the comparison that runs them."""
