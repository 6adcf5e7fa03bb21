"""Index choice and query explanation."""
