"""Named queries that put the operators together."""
