"""DataFrame operators of the index and of search."""
