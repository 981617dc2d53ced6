"""DataFrame operators of the domain."""
