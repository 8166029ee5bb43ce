"""DataFrame operators: joins, windows and aggregates over corpus tables."""
