"""Relations of the engine over the given tables."""
