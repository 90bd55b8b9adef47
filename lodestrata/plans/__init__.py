"""Query registry and the SQL each query is checked against."""
