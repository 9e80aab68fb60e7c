"""DataFrame operators: indexes, candidate search, ranking, resolving."""
