"""Readers of input tables and the shared scratch area between jobs."""

from veil.sources.scratch import drop_table, materialize, shared_dir, ship
from veil.sources.tables import read_table

__all__ = ["drop_table", "materialize", "read_table", "shared_dir", "ship"]
