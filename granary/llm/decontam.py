"""Benchmark decontamination by Wu-Manber search over words.

Each benchmark item gives windows of 8 consecutive words (an item of fewer words is
one window). Patterns of one length form a searcher: a block is the last words of
the text window looked at; its shift table says how far the window can move without
missing any pattern, and a shift of zero leads to the bucket of patterns that end in
this block, which are then compared word by word. The texts are scanned where they
are read; nothing is shuffled. Patterns are broadcast in groups of bounded size, and
the scan is repeated, carrying what was found, for each group.

Defined results: a null or empty text has no words and no hits; a null or wordless
item is never found; items that share a window are all counted; repeated item ids
count once; repeated documents are judged one by one; an empty benchmark hits nothing;
texts of any length are scanned whole; other columns, whatever their names, stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import texts
from .common import Scratch, column, ship, widened

WINDOW = 8
#: Items that make a document contaminated.
MIN_ITEMS = 2
#: Bytes of benchmark text in one broadcast group; item words take about ten times that in a worker.
GROUP_BYTES = 8 << 20

#: A-Z to a-z, other ASCII but digits and letters to space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables for word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set], length: int):
        self.m, self.b = length, min(2, length)
        self.most = self.m - self.b + 1
        self.shift: dict[object, int] = {}
        self.buckets: dict[object, dict[bytes, list[tuple[tuple[bytes, ...], set]]]] = {}
        for p, items in patterns.items():
            for j in range(self.most):
                block = self._block(p, j + self.b - 1)
                self.shift[block] = min(self.shift.get(block, self.most), self.most - 1 - j)
            self.buckets.setdefault(self._block(p, self.m - 1), {}).setdefault(p[0], []).append((p, items))

    def _block(self, w, end: int):
        return w[end] if self.b == 1 else (w[end - 1], w[end])

    def find(self, w: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of each occurrence."""
        shift, most, m, n, one = self.shift.get, self.most, self.m, len(w), self.b == 1
        end = m - 1
        while end < n:
            block = w[end] if one else (w[end - 1], w[end])
            s = shift(block, most)
            if s:
                end += s
                continue
            begin = end - m + 1
            for p, items in self.buckets[block].get(w[begin], ()):
                if tuple(w[begin : end + 1]) == p:
                    yield begin, items
            end += 1


def searchers(items: list[tuple[str, bytes]]) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for name, text in items:
        w = words_of(text)
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1) if m else ():
            by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(name)
    return [Searcher(p, m) for m, p in by_length.items()]


#: Words looked at together in a long text; chunks overlap by a window.
_CHUNK = 1 << 22


def scan(text: bytes, found: list[Searcher]) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit word ranges (begin, end), items; long texts in overlapping pieces."""
    ranges, items, at, last = [], set(), 0, []
    for piece in _pieces(text):
        w = last + words_of(piece)
        for s in found:
            for begin, names in s.find(w):
                ranges.append((at + begin, at + begin + s.m))
                items |= names
        at += max(0, len(w) - (WINDOW - 1))
        last = w[max(0, len(w) - (WINDOW - 1)) :]
    return at + len(last), merged(ranges), items


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > _CHUNK:
        end = at + _CHUNK
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _groups(benchmark: DataFrame) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in groups of bounded bytes, one of them on the driver at a time; and whether a group is the last."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n_bytes = b.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-n_bytes * 3 // (2 * GROUP_BYTES)))
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()], k == n - 1


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_HITS = "ranges array<struct<a:long,b:long>>, items array<string>"
#: Documents with hits up to which these are broadcast to be joined.
BROADCAST_HITS = 50_000


def _found(text: str, group, only: bool, rows: DataFrame, schema: StructType, cut: bool = False) -> DataFrame:
    """``rows`` with words, ranges and items after their columns; with ``only``, those with hits, without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = searchers(group.value)
        for b in texts.small(batches, text):
            n, ranges, items, column = [], [], [], b.column(text)
            for x in texts.raw(column):
                w, r, i = scan(x, found)
                n.append(w)
                ranges.append(r)
                items.append(sorted(i))
            if cut:
                column = _without(column, ranges)
            made = [pa.array(n, pa.int64()), pa.array([[{"a": x, "b": y} for x, y in r] for r in ranges], _RANGES), pa.array(items, pa.list_(pa.string()))]
            own = [k for k in b.schema.names if not only or k != text]
            out = pa.RecordBatch.from_arrays([*(column if k == text else b.column(k) for k in own), *made], [*own, "words", "ranges", "items"])
            yield out.filter(pa.array([bool(r) for r in ranges])) if only else out

    return rows.mapInArrow(run, schema)


def _without(column: pa.Array, ranges: list[list[tuple[int, int]]]) -> pa.Array:
    if not any(ranges):
        return column
    return pa.array([without(x.as_py().encode(), r).decode() if r else x.as_py() for x, r in zip(column, ranges, strict=True)], column.type)


def hits(docs: DataFrame, benchmark: DataFrame, whole: bool = False, cut: bool = False) -> DataFrame:
    """doc_id, text, words (their number), ranges of hit words, and items for every row of ``docs``; with ``whole``, its columns as ``own``.

    With ``cut``, hit words are taken out of the text, and the ranges are those of the old one.
    """
    spark = docs.sparkSession
    ship(spark)
    own = [F.struct(*(column(c) for c in docs.columns if c != "text")).alias("own")] if whole else []
    d = docs.select("doc_id", *own, F.col("text").cast("string").alias("text"))
    groups = _groups(benchmark)
    group, last = next(groups)
    if last:
        return _found("text", spark.sparkContext.broadcast(group), False, d, widened(d.schema, f"words long, {_HITS}"), cut)
    scratch = Scratch(spark)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in texts.small(batches, "text"):
            n = [scan(x, [])[0] for x in texts.raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows)), pa.array(n, pa.int64())], [*b.schema.names, "row", "words"])
            at += b.num_rows

    rows = scratch.save(d.mapInArrow(numbered, widened(d.schema, "row long, words long")), "rows")
    told, k = None, 0
    while True:
        shared = spark.sparkContext.broadcast(group)
        part = scratch.save(_found("text", shared, True, rows.select("row", "text"), StructType.fromDDL(f"row long, words long, {_HITS}")), f"hits{k}")
        shared.destroy()
        told, k = part if told is None else told.union(part), k + 1
        if last:
            break
        group, last = next(groups)
    told = told.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    told = scratch.save(told, "hits")
    names = d.columns
    out = rows.join(F.broadcast(told) if told.count() <= BROADCAST_HITS else told, "row", "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts.small(batches, "text"):
            ranges = [merged([(x["a"], x["b"]) for x in r or ()]) for r in b.column("ranges").to_pylist()]
            items = [i or [] for i in b.column("items").to_pylist()]
            text = _without(b.column("text"), ranges) if cut else b.column("text")
            made = [b.column("words"), pa.array([[{"a": x, "b": y} for x, y in r] for r in ranges], _RANGES), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(text if k == "text" else b.column(k) for k in names), *made], [*names, "words", "ranges", "items"])

    return out.mapInArrow(joined, widened(d.schema, f"words long, {_HITS}"))


def score(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = hits(docs, benchmark)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id", F.col("words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"),
    )


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``text`` less the words in ``ranges`` and what stands between the words of one range."""
    out, at, due = [], 0, iter(ranges)
    a, b = next(due, (-1, -1))
    for i, m in enumerate(_WORD.finditer(text)):
        if i == a:
            out.append(text[at : m.start()])
        if i == b - 1:
            at = m.end()
            a, b = next(due, (-1, -1))
            if a < 0:
                break
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated rows of ``docs`` go; from the others the hit words go. The columns stay; n_chars follows a text that changed."""
    out = hits(docs, benchmark, True, True).where(F.size("items") < MIN_ITEMS)

    def made(name: str):
        if name == "text":
            return F.col("text")
        own = F.col("own")[name]
        if name != "n_chars":
            return own.alias(name)
        return F.when(F.size("ranges") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own).alias(name)

    return out.select(*map(made, docs.columns))
