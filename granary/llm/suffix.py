"""Substring de-duplication over bytes by prefix doubling.

``by_sorting`` is the textbook form: ranks of all positions by Spark's sort, round by
round. It moves over a hundred times its input (figures in the README), so the query
uses ``deduplicated``, which keeps the doubling but not the sort of all positions: the
ranks at 1, 2, 4, ... 32 bytes are 64-bit mixes made in each task, which need no common
numbering, only winnowed positions at ``SEED`` bytes with their contexts meet those of
other documents, and only where contexts part do single positions at ``LENGTH`` bytes,
the threshold (see ``repeats``). Both are held against brute force and each other.

Defined results: texts are UTF-8 bytes; a null text is empty; matches never cross
documents; of repeated rows of one id none is smaller, so none goes for the other; a
null id is larger than any (2^63 - 1 counts as null); texts of any length are
searched whole; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch, ship

LENGTH, SEED = 50, 24

_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def split(whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(whole), np.uint8), np.cumsum([len(x) for x in whole])


def _kept(chunk: repeats.Chunk, gone: np.ndarray) -> pa.Table:
    kept, spans, at = [], [], 0
    for text, end in zip(chunk.texts, chunk.ends.tolist(), strict=True):
        own = gone[at:end]
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
        spans.append([{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(chunk.base[at:end][~own].tobytes() if edges else text)
        at = end
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.table(
        {"doc_id": pa.array(chunk.ids, pa.int64()), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array([len(x) for x in chunk.texts], pa.int64()), "spans": pa.array(spans, pairs)}
    )


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes and the removed byte spans, for every row of ``docs``."""
    kind = repeats.Kind(length, seed, split, _BYTES.__getitem__)
    return repeats.covered(docs, kind, _kept, "doc_id long, kept binary, n_bytes long, spans array<struct<a: long, b: long>>")


#: Bytes that are a position's first rank.
FIRST = 8


def by_sorting(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What ``deduplicated`` gives, by the textbook form: every position, every round, ranks from Spark's sort alone.

    The first rank of a position is its ``FIRST`` bytes. A round pairs the rank at a
    position with that at an offset, sorts the distinct pairs of more than one document,
    and their numbers in this order are the next ranks; a position whose pair is unique
    to one document leaves. Offsets double up to the threshold. No rank is a hash. It
    moves some hundred bytes for each byte of text, so the query uses ``deduplicated``.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, raw in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = raw.as_py()
                ranks = np.ndarray((max(0, len(raw) - FIRST + 1),), ">i8", raw, strides=(1,)).astype(np.int64) if len(raw) >= FIRST else np.zeros(0, np.int64)
                for at in range(0, len(ranks), 1 << 16):
                    part = ranks[at : at + (1 << 16)]
                    n, doc_ = len(part), repeats._LAST if doc is None else doc
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row)), pa.array(np.full(n, doc_)), pa.array(np.arange(at, at + n)), pa.array(part)], ["row", "doc", "pos", "rank"])

    at = rows.select("row", "doc_id", "text").mapInArrow(start, "row long, doc long, pos long, rank long")
    m, k = FIRST, 0
    while m < length:
        step = min(m, length - m)
        pairs = at.join(at.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next")), ["row", "pos"])
        pairs = scratch.save(pairs, f"pairs{k}")
        shared = pairs.groupBy("rank", "next").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
        numbered = scratch.save(shared.orderBy("rank", "next").select("rank", "next", F.monotonically_increasing_id().alias("new")), f"ranks{k}")
        at = scratch.save(pairs.join(numbered, ["rank", "next"]).select("row", "doc", "pos", F.col("new").alias("rank")), f"at{k}")
        m, k = m + step, k + 1
    least = at.groupBy("rank").agg(F.min("doc").alias("least"))
    gone = at.join(least, "rank").where("doc > least").groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans, sizes = [], [], []
            for raw, starts in zip(b.column("text"), b.column("gone").to_pylist(), strict=True):
                raw = np.frombuffer(raw.as_py(), np.uint8)
                steps = np.bincount(starts or [], minlength=len(raw) + 1) - np.bincount(np.array(starts or [], np.int64) + length, minlength=len(raw) + 1)
                own = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"a": x, "b": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(raw[~own].tobytes())
                sizes.append(len(raw))
            kinds = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, kinds)], ["doc_id", "kept", "n_bytes", "spans"])

    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, kept binary, n_bytes long, spans array<struct<a:long,b:long>>")


def digests(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = deduplicated) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return find(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
