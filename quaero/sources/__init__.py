"""Reading and writing corpus tables."""
