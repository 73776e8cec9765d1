"""Operators over DataFrames: rows (``rows``) and keys (``keys``)."""

from .keys import first_wins, last_wins, repeated, violations, within, without
from .rows import concat, discard, emit, filtered, group_aggregate, project, rename, scan, scan_reverse, set_column, skip, sort, take, union, with_ordinals

__all__ = [
    "concat", "discard", "emit", "filtered", "first_wins", "group_aggregate", "last_wins", "project", "rename", "repeated", "scan",
    "scan_reverse", "set_column", "skip", "sort", "take", "union", "violations", "with_ordinals", "within", "without",
]
