"""Column functions: built-in Spark expressions, no shuffles."""
