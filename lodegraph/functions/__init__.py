"""Column functions: path, text, SQL and scoring expressions."""
