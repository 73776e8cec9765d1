"""Strings of ``length`` units that repeat across documents, found by ranks at winnowed positions.

Units are bytes or words; a window is ``length`` consecutive units of one document.
Every window has an anchor: the ``seed``-gram of least rank in it. Consecutive windows
of one anchor form its context, ``seed`` to about twice ``length`` units long. Equal
windows have equal anchors at equal places, so only documents that share an anchor can
share a window.

1. Documents are packed into chunks of about ``CHUNK`` bytes, written compressed.
2. Each chunk sends, per bucket of anchor ranks, its distinct (anchor, context) ranks
   with the least document of each. A bucket sorts the pairs of all chunks and answers
   each chunk: nothing, a smaller document has the same context (all its units go), or
   the anchor occurs in other contexts too.
3. For the last kind only, and only for the least document of each context, chunks
   send the ranks of the single windows; buckets answer with the windows that a smaller
   document has.
4. Each chunk removes what was found.

Ranks come from prefix doubling: the rank at 2m units is made of the ranks at m units
at offsets 0 and m. They are 64-bit mixes, so equal ranks need no exchange to agree;
pairs that decide anything have 80 bits or more.

What a chunk sends of an anchor or a context is one entry, however many of its
documents share it, and a document's group is never together anywhere: a passage that
a third of all documents have costs each bucket one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Bytes of text in a chunk; one document at least.
CHUNK = 1 << 20
#: Units whose ranks are held at a time; a power of two.
SLICE = 1 << 17
#: Documents in a chunk at most.
DOCS = 1 << 15
#: Bytes of text whose anchors meet in one bucket.
BUCKET = 16 << 20

_K = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)

KEEP, REMOVE, ASK = 0, 1, 2


@dataclass(frozen=True)
class Kind:
    """What a unit is.

    ``split`` gives the units of texts, one after the other, and where each text's end;
    ``rank`` gives the ranks of some of these units.
    """

    length: int
    seed: int
    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    rank: Callable[[np.ndarray], np.ndarray]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the pair (a, b)."""
    x = a * _K
    x ^= x >> _S32
    x += b
    x *= _K2
    x ^= x >> _S29
    return x


def doubled(ranks: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Ranks at 1, 2, 4, ... up to ``most`` units; each one shorter than the last by what it looks ahead."""
    out, m = {1: ranks}, 1
    while 2 * m <= most:
        r = out.pop(m) if m > 1 else out[1]
        out[2 * m] = pair(r[:-m], r[m:]) if len(r) > m else r[:0]
        if 4 * m > most and m > 1:
            out[m] = r
        m *= 2
    return out


def at_length(ranks: dict[int, np.ndarray], n: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Ranks at ``n`` units, of the two overlapping power-of-two ranks that span it."""
    m = max(k for k in ranks if k <= n)
    if m == n:
        return ranks[m][at]
    if isinstance(at, slice):
        r = ranks[m]
        return pair(r[: len(r) - (n - m)], r[n - m :])
    return pair(ranks[m][at], ranks[m][at + (n - m)])


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys."""
    m, n = keys, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if width > n else m


@dataclass
class Anchors:
    """Of one slice: by anchor, its place, first and last window start, document number, anchor and context rank."""

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    rank: np.ndarray
    context: np.ndarray
    ranks: dict[int, np.ndarray]


def anchors(units: np.ndarray, ends: np.ndarray, kind: Kind) -> Anchors | None:
    """Anchors of concatenated documents that end at ``ends``."""
    length, n = kind.length, len(units)
    if n < length:
        return None
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    starts = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if not len(starts):
        return None
    ranks = doubled(units, length)
    seeds = at_length(ranks, kind.seed)
    low = np.uint64(SLICE * 2 - 1)
    keys = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    place = (least_in(keys, length - kind.seed + 1)[starts] & low).astype(np.int64)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    last = starts[np.append(begin[1:], len(starts)) - 1]
    first, place = starts[begin], place[begin]
    block = max(k for k in ranks if k <= length)
    b, n_units = ranks[block], last - first + length
    context = pair(pair(b[first], b[first + (n_units - block) // 2]), pair(b[last + length - block], n_units.astype(np.uint64) << np.uint64(20) | (place - first).astype(np.uint64)))
    return Anchors(first, last, doc[first], seeds[place], context, ranks)


def slices(base: np.ndarray, ends: np.ndarray, kind: Kind) -> Iterator[tuple[int, Anchors]]:
    """(first unit, anchors) of slices that overlap by a window less one unit, so each window start lies in one."""
    for at in range(0, len(base), SLICE - kind.length + 1):
        stop = min(at + SLICE, len(base))
        begin = int(np.searchsorted(ends, at, "right"))
        inside = ends[begin : int(np.searchsorted(ends, stop - 1, "right")) + 1]
        found = anchors(kind.rank(base[at:stop]), np.minimum(inside, stop) - at, kind)
        if found is not None:
            found.doc += begin
            yield at, found
        if stop == len(base):
            return


class Entries:
    """Distinct pairs of ranks of a chunk in the order of their buckets, with the least document of each."""

    def __init__(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, buckets: int):
        self.ids_of_rows = ids
        one, two = pair(one, one) >> np.uint64(24), two >> np.uint64(16)
        order = np.argsort(one << np.uint64(24) | (two & np.uint64(0xFFFFFF)), kind="stable")
        one, two, ids = one[order], two[order], ids[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        begin = np.flatnonzero(new)
        self.one, self.two = one[begin], two[begin]
        self.least = np.minimum.reduceat(ids, begin) if len(ids) else ids
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.bucket = ((self.one >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def packed(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, entries, their bytes) for each bucket that has some."""
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(cut, np.append(cut, len(self.bucket))[1:], strict=True):
            known, number = np.unique(self.least[a:b], return_inverse=True)
            planes = np.empty((13, b - a), np.uint8)
            planes[:5] = self.one[a:b].view(np.uint8).reshape(-1, 8)[:, :5].T
            planes[5:11] = self.two[a:b].view(np.uint8).reshape(-1, 8)[:, :6].T
            planes[11:] = number.astype(np.uint16).view(np.uint8).reshape(-1, 2).T
            yield int(self.bucket[a]), int(b - a), zstandard.compress(planes.tobytes() + known.tobytes(), 1)

    def verdicts(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """By row: what the buckets say of its entry, or REMOVE if the chunk itself has a smaller document."""
        status = np.zeros(len(self.one), np.uint8)
        for bucket, body in answers:
            told = np.frombuffer(zstandard.decompress(body), np.uint8)
            at = int(np.searchsorted(self.bucket, bucket))
            status[at : at + len(told)] = told
        out = status[self.entry]
        out[self.ids_of_rows > self.least[self.entry]] = REMOVE
        return out


def unpacked(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(body)
    planes = np.frombuffer(raw, np.uint8, 13 * n).reshape(13, n)
    wide = np.zeros((3, n, 8), np.uint8)
    wide[0, :, :5], wide[1, :, :6], wide[2, :, :2] = planes[:5].T, planes[5:11].T, planes[11:].T
    one, two, number = wide.view(np.uint64)[..., 0]
    return one, two, np.frombuffer(raw, np.int64, offset=13 * n)[number]


def judged(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """KEEP, REMOVE (a smaller document has this pair) or ASK (another document has ``one`` with another ``two``)."""
    order = np.lexsort((ids, two, one))
    one, two, d = one[order], two[order], ids[order]
    new_one = np.append(True, one[1:] != one[:-1])
    new_two = new_one | np.append(True, two[1:] != two[:-1])
    of_one, begin = np.cumsum(new_one) - 1, np.flatnonzero(new_one)
    shared = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
    several = np.bincount(of_one[new_two]) > 1
    status = np.where((shared & several)[of_one], np.uint8(ASK), np.uint8(KEEP))
    status[d[np.flatnonzero(new_two)][np.cumsum(new_two) - 1] < d] = REMOVE
    out = np.empty(len(order), np.uint8)
    out[order] = status
    return out


_CHUNKS = "chunk long, ids array<long>, sizes array<long>, n_bytes long, body binary"
_SENT = "bucket int, chunk long, n int, body binary"
_TOLD = "chunk long, kind int, bucket int, body binary"
#: Stands for a null doc_id: no other document's id is larger.
_LAST = (1 << 63) - 1


def chunked(docs: DataFrame) -> DataFrame:
    """Texts (null: empty) in compressed chunks with their ids and byte lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def out() -> pa.RecordBatch:
            body = zstandard.compress(b"".join(parts), 3)
            return pa.RecordBatch.from_pydict(
                {"chunk": [number], "ids": [ids], "sizes": [[len(x) for x in parts]], "n_bytes": [held], "body": [body]},
                pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("body", pa.binary())]),
            )

        for b in batches:
            for k, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                raw = text.as_py() or b""
                if parts and (held + len(raw) > CHUNK or len(parts) >= DOCS):
                    yield out()
                    number, ids, parts, held = number + 1, [], [], 0
                ids.append(k)
                parts.append(raw)
                held += len(raw)
        if parts:
            yield out()

    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, _CHUNKS)


class Chunk:
    def __init__(self, row: dict, kind: Kind):
        body, sizes = zstandard.decompress(row["body"]), row["sizes"]
        ends = np.cumsum(sizes)
        self.ids, self.kind = row["ids"], kind
        self.order = np.array([_LAST if k is None else k for k in self.ids], np.int64)
        self.texts = [body[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
        self.base, self.ends = kind.split(self.texts)

    def anchors(self, buckets: int) -> tuple[list[tuple[int, Anchors]], Entries]:
        found = list(slices(self.base, self.ends, self.kind))
        return found, Entries(*(_joined([x(a) for _, a in found], t) for x, t in ((lambda a: a.rank, np.uint64), (lambda a: a.context, np.uint64), (lambda a: self.order[a.doc], np.int64))), buckets)

    def asked(self, found: list[tuple[int, Anchors]], verdicts: np.ndarray, buckets: int) -> tuple[np.ndarray, Entries]:
        """Starts of the windows of the anchors with verdict ASK, and their ranks as entries."""
        at, out = 0, []
        m = max(k for k in found[0][1].ranks if k <= self.kind.length) if found else 0
        for begin, a in found:
            of = np.flatnonzero(verdicts[at : at + len(a.first)] == ASK)
            at += len(a.first)
            n = a.last[of] - a.first[of] + 1
            start = np.repeat(a.first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            r, ahead = a.ranks[m], self.kind.length - m
            out.append((start + begin, pair(r[start], r[start + ahead]), pair(r[start + ahead], r[start]), np.repeat(self.order[a.doc[of]], n)))
        starts, one, two, ids = (_joined([x[i] for x in out], t) for i, t in enumerate((np.int64, np.uint64, np.uint64, np.int64)))
        return starts, Entries(one, two, ids, buckets)

    def covered(self, answers: dict[int, list[tuple[int, bytes]]], buckets: int) -> np.ndarray:
        """Whether each unit lies in a window that a smaller document has."""
        found, entries = self.anchors(buckets)
        verdicts = entries.verdicts(answers[0])
        starts, windows = self.asked(found, verdicts, buckets)
        gone, n = starts[windows.verdicts(answers[1]) == REMOVE], self.kind.length
        whole = verdicts == REMOVE
        first = _joined([a.first + at for at, a in found], np.int64)[whole]
        last = _joined([a.last + at for at, a in found], np.int64)[whole]
        size = len(self.base) + 1
        steps = np.bincount(np.concatenate([first, gone]), minlength=size) - np.bincount(np.concatenate([last, gone]) + n, minlength=size)
        return np.cumsum(steps[:-1]) > 0


def _joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _sent(number: int, entries: Entries) -> pa.RecordBatch:
    rows = list(entries.packed())
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())],
        ["bucket", "chunk", "n", "body"],
    )


def _rows(table: pa.Table) -> Iterator[dict]:
    for b in table.to_batches():
        for i in range(b.num_rows):
            yield {k: b.column(k)[i].as_py() for k in b.schema.names}


def _answers(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for r in _rows(table):
        out[r["kind"]].append((r["bucket"], r["body"]))
    return out


def _answered(sent: DataFrame, kind: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = list(_rows(table))
        parts = [unpacked(r["n"], r["body"]) for r in rows]
        status = judged(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        chunk, bucket, body, at = [], [], [], 0
        for r in rows:
            own = status[at : at + r["n"]]
            at += r["n"]
            if own.any():
                chunk.append(r["chunk"])
                bucket.append(r["bucket"])
                body.append(zstandard.compress(own.tobytes(), 1))
        return pa.table(
            {"chunk": pa.array(chunk, pa.int64()), "kind": pa.array([kind] * len(chunk), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "body": pa.array(body, pa.binary())}
        )

    return sent.groupBy("bucket").applyInArrow(run, _TOLD)


def covered(docs: DataFrame, kind: Kind, result: Callable[[Chunk, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``result`` of each chunk and of whether its units are covered by a window that also starts in a smaller document.

    Each step is cut by a written table in the shared folder, so a lost executor costs
    one step at most. No rows go to the driver but one sum.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.save(chunked(docs), "chunks")
    buckets = max(8, -(-(chunks.agg(F.sum("n_bytes")).head()[0] or 0) // BUCKET))

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = Chunk({k: b.column(k)[i].as_py() for k in ("ids", "sizes", "body")}, kind)
                yield _sent(b.column("chunk")[i].as_py(), c.anchors(buckets)[1])

    def windows_of(chunk: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in _rows(chunk):
            c = Chunk(row, kind)
            found, entries = c.anchors(buckets)
            out.append(_sent(row["chunk"], c.asked(found, entries.verdicts(_answers(told)[0]), buckets)[1]))
        return pa.Table.from_batches(out, _sent(0, Entries(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)), 1)).schema)

    def done(chunk: pa.Table, told: pa.Table) -> pa.Table:
        made = [result(c := Chunk(row, kind), c.covered(_answers(told), buckets)) for row in _rows(chunk)]
        return pa.concat_tables(made)

    told = scratch.save(_answered(chunks.mapInArrow(anchors_of, _SENT), 0), "anchors")
    scratch.settle()
    by_chunk = chunks.select("chunk", "ids", "sizes", "body").groupBy("chunk")
    windows = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(windows_of, _SENT)
    told = told.union(scratch.save(_answered(windows, 1), "windows"))
    scratch.settle()
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(done, schema)
