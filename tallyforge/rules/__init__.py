"""Fixed rule tables. Every table may be replaced by a caller's own of the same shape."""
