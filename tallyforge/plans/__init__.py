"""Registered queries: operators applied to the given tables, with their SQL checks."""

from . import history, inventory, logs, quality, scans, sessions, specs, stores, streams
from . import inout  # isort: skip, builds on views of the others

ALL = (logs, scans, inventory, history, stores, quality, specs, sessions, streams, inout)
