"""Driver-facing queries and their SQL, one module per operator category."""
