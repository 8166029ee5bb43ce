"""Word lists, patterns and small dimensions that decide results."""
