"""DataFrame operators: every function returns a lazily evaluated DataFrame."""
