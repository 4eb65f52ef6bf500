"""Structured Streaming forms of the log, memory, session and scan operators."""
