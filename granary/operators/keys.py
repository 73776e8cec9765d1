"""Constraints as joins and aggregates: rows are never looked up one by one.

A key is a list of columns. A UNIQUE key with a NULL in it binds nothing; a primary key
has none. Batches carry an ordinal (``ORDER``), since which of two clashing rows stays
depends on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: With a character that separates nothing and that no table may use in a name.
ORDER = "__n\u2063"


def whole(key: Sequence[str]) -> Column:
    """Whether no part of the key is NULL."""
    out = F.col(f"`{key[0]}`").isNotNull()
    for k in key[1:]:
        out = out & F.col(f"`{k}`").isNotNull()
    return out


def violations(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> str | None:
    """The first rule (name, condition of a broken row) that some row breaks; one pass for all of them."""
    if not rules:
        return None
    found = df.agg(*(F.max(c).alias(f"r{i}") for i, (_, c) in enumerate(rules))).head()
    return next((name for i, (name, _) in enumerate(rules) if found[i]), None)


def repeated(df: DataFrame, key: Sequence[str]) -> bool:
    """Whether two rows share a whole key."""
    return bool(df.filter(whole(key)).groupBy(*(F.col(f"`{k}`") for k in key)).count().filter("count > 1").limit(1).count())


def within(old: DataFrame, new: DataFrame, key: Sequence[str], rows: int | None) -> DataFrame:
    """Rows of ``old`` whose key is in ``new``. A batch of few known rows is broadcast, and its range goes to the scan."""
    keys = new.filter(whole(key)).select(*(F.col(f"`{k}`") for k in key))
    if rows is not None and rows <= SMALL:
        first = F.col(f"`{key[0]}`")
        ends = keys.agg(F.min(first), F.max(first)).head()
        if ends[0] is None:
            return old.limit(0)
        old, keys = old.filter(first.between(F.lit(ends[0]), F.lit(ends[1]))), F.broadcast(keys)
    return old.join(keys, list(key), "left_semi").select(*old.columns)


#: Rows of a batch up to which its keys are broadcast.
SMALL = 100_000


def without(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``; those with a NULL in it stay."""
    keys = new.filter(whole(key)).select(*(F.col(f"`{k}`") for k in key)).distinct()
    return old.join(keys, list(key), "left_anti").select(*old.columns)


def last_wins(batch: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """What is left of a batch whose later rows replace earlier ones: the rows that are the last of each of their keys."""
    return _extreme(batch, keys, F.max)


def _extreme(batch: DataFrame, keys: Sequence[Sequence[str]], pick) -> DataFrame:
    columns = batch.columns
    out = batch
    for i, key in enumerate(keys):
        best = batch.filter(whole(key)).groupBy(*(F.col(f"`{k}`") for k in key)).agg(pick(ORDER).alias(f"{ORDER}{i}"))
        out = out.join(best, list(key), "left").filter(F.col(f"{ORDER}{i}").isNull() | (F.col(f"{ORDER}{i}") == F.col(ORDER))).select(*columns)
    return out


def first_wins(batch: DataFrame, keys: Sequence[Sequence[str]], save) -> DataFrame:
    """What is left of a batch whose rows give way to kept earlier ones.

    One key: the first row of each. Several: a row may clash with one that itself gives
    way, so rounds keep the rows that are first in all their keys and drop those that
    clash with these, until none is undecided. ``save`` writes a round's result.
    """
    if len(keys) == 1:
        return _extreme(batch, keys, F.min)
    kept, left = None, batch
    while True:
        first = save(_extreme(left, keys, F.min))
        kept = first if kept is None else kept.union(first)
        rest = left.join(first.select(ORDER), ORDER, "left_anti").select(*batch.columns)
        for key in keys:
            rest = without(rest, first, key)
        left = save(rest)
        if not left.limit(1).count():
            return kept
