"""Near-duplicates by SimHash, linked through a distributed vantage-point tree.

Fingerprints are made in Arrow batches; equal ones are merged first. The upper
levels of the tree are fitted on a bounded sample and only say where a fingerprint
goes; every fingerprint is routed. A node sends what lies within ``mu`` of its
vantage point inside and the rest outside; what lies within ``mu + radius`` goes
inside as a guest too, so by the triangle inequality two fingerprints within
``radius`` of each other meet in at least one shard. A shard splits its own
fingerprints in the same way down to small blocks, which are compared exactly.
Within a block links become a spanning tree, never all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; texts of any length are read whole, in pieces; repeated rows and repeated ids
stay; a null doc_id never becomes a component id unless no other is reachable; other
columns, whatever their names, are not looked at, or stay (``keep_one``); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import texts
from .common import Scratch, chosen, column, ship, widened
from .graph import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a shard, about; a shard is one group of one task.
SHARD = 20_000
#: Sampled fingerprints per shard for fitting the upper tree, and the most in all.
FIT, MOST_FIT = 64, 1 << 17
#: Fingerprints that are compared in all pairs, and the most that one side of a split may keep.
BLOCK, SIDE = 192, 0.75


def _add_bits(h: np.ndarray, ones: np.ndarray) -> None:
    if len(h) < 4096:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    by_byte = h.view(np.uint8).reshape(-1, 8)
    ones += np.concatenate([np.bincount(by_byte[:, j], minlength=256) @ table for j in range(8)])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for piece in texts.pieces(text):
        words = last + piece.lower().split()
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        _add_bits(h, ones)
        n += len(h)
        last = words[-(shingle - 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def of_sets(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of ``n`` sets of shingle hashes (their numbers, sorted, and hashes); that of an empty set is zero."""
    out, size = np.zeros(n, np.uint64), np.bincount(of, minlength=n)
    own = np.flatnonzero(size)
    if len(own):
        begin = (np.cumsum(size) - size)[own]
        for bit in map(np.uint64, range(64)):
            ones = np.add.reduceat(((x >> bit) & np.uint64(1)).astype(np.uint32), begin)
            out[own] |= (2 * ones.astype(np.int64) > size[own]).astype(np.uint64) << bit
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts.small(batches, "text"):
            fps = np.fromiter(map(fingerprint, texts.raw(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    ship(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _split(x: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and mu whose larger side, guests included, is the smallest of some tries."""
    best = None
    for v in rng.choice(x, min(6, len(x)), replace=False):
        counts = np.cumsum(np.bincount(np.bitwise_count(x ^ v), minlength=65 + radius))
        for mu in range(64):
            inner, outer = counts[min(mu + radius, 64)], counts[64] - counts[mu]
            cost = (max(inner, outer) > SIDE * len(x), inner * np.log2(inner + 1) + outer * np.log2(outer + 1))
            if max(inner, outer) < 0.95 * len(x) and (best is None or cost < best[0]):
                best = (cost, int(v), mu)
    return best and best[1:]


def fit(sample: np.ndarray, leaf: int, radius: int = RADIUS) -> tuple[list, int]:
    """Nested [vantage, mu, inside, outside] down to ``leaf`` sampled fingerprints, where [shard number]; number of shards."""
    rng, leaves = np.random.default_rng(0), iter(range(1 << 30))

    def grow(x: np.ndarray, depth: int) -> list:
        cut = _split(x, radius, rng) if depth and len(x) > leaf else None
        if cut is None:
            return [next(leaves)]
        d = np.bitwise_count(x ^ np.uint64(cut[0]))
        return [*cut, grow(x[d <= cut[1] + radius], depth - 1), grow(x[d > cut[1]], depth - 1)]

    return grow(sample, 64), next(leaves)


def _route(tree: list, x: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(at):
        return
    if len(tree) == 1:
        yield tree[0], at
        return
    d = np.bitwise_count(x[at] ^ np.uint64(tree[0]))
    yield from _route(tree[2], x, at[d <= tree[1] + radius], radius)
    yield from _route(tree[3], x, at[d > tree[1]], radius)


def _spanning(x: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected among distinct ``x``: all, or a spanning forest if there are many."""
    if len(x) <= 1024:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
        if len(i) <= 4 * len(x):
            yield from zip(x[i].tolist(), x[j].tolist(), strict=True)
            return
    left = x.copy()
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(left ^ p) <= radius
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                yield from zip(repeat(int(p)), found.tolist())


def shard_links(x: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Star links (least of a component, member) among the fingerprints of one shard."""
    rng, parent = np.random.default_rng(1), {}

    def root(a: int) -> int:
        while (p := parent.get(a, a)) != a:
            parent[a] = parent.get(p, p)
            a = p
        return a

    stack = [np.unique(x)]
    while stack:
        part = stack.pop()
        cut = _split(part, radius, rng) if len(part) > BLOCK else None
        if cut is None:
            for a, b in _spanning(part, radius):
                a, b = sorted((root(a), root(b)))
                parent[a], parent[b] = a, a
        else:
            d = np.bitwise_count(part ^ np.uint64(cut[0]))
            stack += [part[d <= cut[1] + radius], part[d > cut[1]]]
    return [(root(a), a) for a in list(parent) if root(a) != a]


def links(unique: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within ``radius``."""
    n = unique.count()
    tree, shards = [0], 1
    if n > shard:
        most = min(MOST_FIT, FIT * -(-n // shard))
        below = int(min(1.0, 1.25 * most / n + 64 / n) * ((1 << 64) - 1)) - (1 << 63)  # so that no task sends many more than its share
        sample = unique.where(F.xxhash64("fp") <= F.lit(below)).orderBy(F.xxhash64("fp"), "fp").limit(most).toPandas()["fp"].to_numpy(np.int64)
        tree, shards = fit(sample.view(np.uint64), max(16, len(sample) * shard // n), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, at in _route(tree, x, np.arange(len(x)), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(x[at].view(np.int64))], ["shard", "fp"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        found = np.array(shard_links(group["fp"].to_numpy(np.int64).view(np.uint64), radius), np.uint64).reshape(-1, 2)
        return pd.DataFrame(found.view(np.int64), columns=["a", "b"])

    ship(unique.sparkSession)
    routed = unique.select("fp").mapInArrow(route, "shard int, fp long")
    spread = routed.repartition(2 * shards, "shard") if shards > 1 else routed  # small shards are long work: their tasks must not be merged
    return spread.groupBy("shard").applyInPandas(join, "a long, b long")


def stars(rows: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(a, b) of ``rows`` (row, fp): each row whose fingerprint reaches that of a lesser row, with the least row it reaches."""
    found = scratch.save(links(rows.select("fp").distinct(), radius), "reached")
    keyed = rows.select("row", "fp", F.col("fp").alias("key"))
    if found.limit(1).count():
        labels = connected_components(found, Scratch(rows.sparkSession))
        keyed = rows.join(labels, rows["fp"] == labels["node"], "left").select("row", "fp", F.coalesce("label", "fp").alias("key"))
    least = keyed.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return keyed.join(least, "key").where("row <> a").select("a", F.col("row").alias("b"))


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs), "fps")
    unique = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    labels = connected_components(links(unique, radius), scratch)
    keyed = unique.join(labels, unique["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("key"))
    least = keyed.groupBy("key").agg(F.min("first").alias("component_id"))
    of_fp = keyed.select("fp", "key").join(least, "key").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of linked rows of ``docs``, the one with the least doc_id (null last); columns stay.

    Rows are told apart by a number of their own, so a repeated id loses no other text.
    """
    scratch = Scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in texts.small(batches, "text"):
            fps = np.fromiter(map(fingerprint, texts.raw(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("own"), b.column("doc_id"), pa.array(fps.view(np.int64)), pa.array(np.arange(row, row + b.num_rows))], ["own", "doc_id", "fp", "row"])
            row += b.num_rows

    ship(docs.sparkSession)
    d = docs.select(F.struct(*(column(c) for c in docs.columns)).alias("own"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = scratch.save(d.mapInArrow(run, widened(StructType(d.schema.fields[:2]), "fp long, row long")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    unique = scratch.save(rows.groupBy("fp").agg(first.alias("first")), "unique")
    labels = connected_components(links(unique, radius), scratch)
    keyed = unique.join(labels, unique["fp"] == labels["node"], "left").select("first", F.coalesce("label", "fp").alias("key"))
    kept = keyed.groupBy("key").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return chosen(rows, "row", scratch.save(kept, "kept"), "left_semi").select("own.*")
