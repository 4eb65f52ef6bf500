"""DataFrame -> DataFrame operators, keyed by repo or service."""
