"""Readers that turn landed files into canonical tables, and the sinks."""
