"""Mixture-controlled packing of tokenized documents into fixed windows.

Each source is a queue. Every window takes tokens of the queues by deficit
round-robin: a queue earns its share of the window, is served the whole tokens it
has earned, and carries the rest to the next window. Shares are whole numbers of
tokens per cycle of ``CYCLE`` windows, so that all deficits are zero again after a
cycle and the schedule of one cycle holds for as many cycles as the queues last. The
schedule is therefore a small table (bounded by queues and ``CYCLE``, not by the
corpus), from which any task finds the window of any token of a queue by arithmetic:
deficits carry across windows and partitions, yet no task waits for another.

Up to ``QUEUES`` queues share one schedule. More are dealt into groups, each with a
schedule of its own that hands out as many tokens at a time as the group earns in a
window; groups are the queues of the level above, up to one last level. So each source
keeps its share of a window whatever their number, and no schedule is collected: each
is made in one task from at most about ``QUEUES`` totals and joined where it is needed.

One pass tokenizes and writes ids with each document's place in its partition's part
of the queue; a window sum over (queue, partition) totals gives where each part
begins; a second pass cuts documents into pieces. Ids are written once. A source with
a third of all rows is no group anywhere: its rows stay where they are.

Defined results: a null or empty text is one token (the end id); a text of any length
is packed whole; a null source is a queue of its own; repeated rows are packed as often
as they occur; only the last window can be short, so padding is less than one window; a
source without a stated proportion comes after those with one, and the share of a source
that has ended passes to the others of its group, then to all; other columns, whatever
their names, are not looked at; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import texts, tokens
from .common import Scratch, ship

WINDOW = 2048
END = 1
#: Queues of one schedule; with more, groups of about half as many.
QUEUES = 64
CYCLE = 16
#: Rows of a partition, about, and the most partitions, where documents are put in order first.
ROWS, PARTITIONS = 1 << 10, 1 << 16
#: Bytes of the table of (queue, partition) up to which it is broadcast.
BROADCAST = 32 << 20


def ordered(docs: DataFrame) -> DataFrame:
    """``docs`` in an order that depends on its rows alone, not on the files or partitions they come from.

    ``pack`` takes documents as they lie; of these it makes the same pieces in every run.
    One shuffle of whole rows, to as many partitions as the count of rows tells. Rows
    equal in doc_id, source and text meet in one task, which sorts by spilling, so copies
    should be gone before; where ``pack`` may cut as it likes, leave this out.
    """
    keys = [k for k in ("doc_id", "text", "source") if k in docs.columns]
    n = min(docs.count() // ROWS + 1, PARTITIONS)
    return docs.repartition(n, *keys).sortWithinPartitions(*keys)


def encoded(docs: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """doc_id, queue, ids (little-endian unsigned 16 or 32 bits), and the place in the partition's part of the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, "ids")
        width = tokens.width(tokenizer)
        part, held, end = TaskContext.get().partitionId(), {}, END.to_bytes(width, "little")
        for b in texts.small(batches, "text", tokens.BATCH):
            ids, starts, queues = [], [], b.column("queue").to_pylist()
            for q, found in zip(queues, tokens.walk(encode, list(texts.raw(b.column("text")))), strict=True):
                ids.append(b"".join(found) + end)
                starts.append(held.get(q, 0))
                held[q] = starts[-1] + len(ids[-1]) // width
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("queue"), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64())],
                ["doc_id", "queue", "ids", "n", "part", "start_in_part"],
            )

    ship(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), source), F.lit("null")).alias("queue"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, queue string, ids binary, n long, part int, start_in_part long")


def shares(left: np.ndarray, target: np.ndarray, per_cycle: int) -> np.ndarray:
    """Whole tokens per cycle, by largest remainder, for queues with tokens left; one at least for each."""
    weight = np.where(left > 0, np.maximum(target, 1e-12), 0.0)
    if not weight.sum():
        return np.zeros(len(left), np.int64)
    exact = weight / weight.sum() * (per_cycle - (left > 0).sum())
    out = np.floor(exact).astype(np.int64)
    rest = int(per_cycle - (left > 0).sum() - out.sum())
    order = np.argsort(-(exact - out) - (left > 0), kind="stable")
    out[order[:rest]] += 1
    return out + (left > 0)


def _serve(credit: np.ndarray, earned: np.ndarray, left: np.ndarray, size: int, cycle: int) -> np.ndarray:
    """One window: earn, serve whole tokens, fill what is over in the order of the deficits. Credits are in 1/cycle tokens."""
    credit += np.where(left > 0, earned, 0)
    take = np.minimum(np.maximum(credit // cycle, 0), left)
    while (over := int(take.sum()) - size) > 0:
        big = int(np.argmax(np.where(take > 0, take * cycle - credit, -np.inf)))
        take[big] -= min(over, take[big])
    while (room := size - int(take.sum())) > 0 and (take < left).any():
        open_ = take < left
        first = int(np.argmax(np.where(open_, credit - take * cycle, -np.inf)))
        take[first] += 1 if credit[first] - take[first] * cycle > 0 else min(room, max(1, room // int(open_.sum())), left[first] - take[first])
    credit -= take * cycle
    return take


class Schedule:
    """Segments (first window, cycles, tokens of each queue before it, cumulated takes of its cycle)."""

    def __init__(self, totals: np.ndarray, target: np.ndarray, size: int = WINDOW, cycle: int = CYCLE):
        left, window, served, self.size = totals.astype(np.int64).copy(), 0, np.zeros(len(totals), np.int64), size
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        while left.any():
            per_cycle = shares(left, target, size * cycle)
            credit, takes = np.zeros(len(left), np.int64), []
            n = int(np.min(np.where(per_cycle > 0, left // np.maximum(per_cycle, 1), np.iinfo(np.int64).max)))
            room = left if n == 0 else np.full(len(left), np.iinfo(np.int64).max // 2) * (left > 0)
            room = room.copy()
            for _ in range(cycle):
                takes.append(_serve(credit, per_cycle, room, size, cycle))
                room -= takes[-1]
                if n == 0 and ((room <= 0) & (per_cycle > 0)).any():
                    break  # a queue has ended: shares are dealt anew
            n = max(n, 1)
            takes_ = np.array(takes)
            ends = np.cumsum(takes_, axis=0)
            offsets = np.cumsum(takes_, axis=1) - takes_
            self.segments.append((window, n, served.copy(), ends, offsets))
            served += ends[-1] * n
            left -= ends[-1] * n
            window += len(takes) * n
        self.windows = window

    def of_queue(self, q: int) -> list[dict]:
        """Segments that serve a queue: tokens before, tokens per cycle, cycles, first window, ends and offsets by window."""
        out = [(b[q], e[-1, q], n, w, e[:, q], o[:, q]) for w, n, b, e, o in self.segments if e[-1, q]]
        return [{k: x.tolist() if isinstance(x, np.ndarray) else int(x) for k, x in zip(_SEGMENT, s, strict=True)} for s in out]


_SEGMENT = {"before": pa.int64(), "per": pa.int64(), "cycles": pa.int64(), "window": pa.int64(), "ends": pa.list_(pa.int64()), "offsets": pa.list_(pa.int64())}
_SEGMENTS = "array<struct<before:long,per:long,cycles:long,window:long,ends:array<long>,offsets:array<long>>>"
_CHAIN = f"array<struct<size:long,segments:{_SEGMENTS}>>"


def _pieces(segments: list[dict], at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(tokens before, length, window, offset) of the tokens at..at+n of a queue."""
    done = 0
    k = bisect_right(segments, at, key=lambda s: s["before"]) - 1
    while done < n:
        s = segments[k]
        cycle, rest = divmod(at + done - s["before"], s["per"])
        if cycle >= s["cycles"]:
            k += 1
            continue
        ends = s["ends"]
        j = bisect_right(ends, rest)
        begin = ends[j - 1] if j else 0
        length = min(ends[j] - rest, n - done)
        yield done, length, s["window"] + cycle * len(ends) + j, s["offsets"][j] + rest - begin
        done += length


def _placed(chain: list[dict], at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """The same through the levels of ``chain``: the windows of a group, one after the other, are a queue of the level above."""
    for piece in _pieces(chain[0]["segments"], at, n):
        if len(chain) == 1:
            yield piece
            continue
        done, length, window, offset = piece
        for d, part, w, o in _placed(chain[1:], window * chain[0]["size"] + offset, length):
            yield done + d, part, w, o


def _level(keys: DataFrame, size: int) -> tuple[DataFrame, DataFrame | None]:
    """Of keys (key, n, target): (key, up, size, segments), and the keys of the level above unless this is the last one."""
    count, all_ = keys.agg(F.count(F.lit(1)), F.sum("target")).head()
    groups = 1 if count <= QUEUES else -(-2 * count // QUEUES)
    dealt = keys.withColumn("up", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("string"))

    def scheduled(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        totals, targets = table.column("n").to_numpy(), table.column("target").to_numpy()
        own = size if groups == 1 else max(-(-4 * len(totals) // CYCLE), round(size * targets.sum() / all_) if all_ else 0)
        plan = Schedule(totals, targets, own)
        made = pa.array([plan.of_queue(k) for k in range(len(totals))], pa.list_(pa.struct(list(_SEGMENT.items()))))
        return pa.table({"key": table.column("key"), "up": table.column("up"), "size": pa.array([own] * len(totals), pa.int64()), "segments": made})

    plans = dealt.groupBy("up").applyInArrow(scheduled, f"key string, up string, size long, segments {_SEGMENTS}")
    above = dealt.groupBy(F.col("up").alias("key")).agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
    return plans, above if groups > 1 else None


def _ranges(rows: DataFrame) -> DataFrame:
    """(queue, part, begin, key, from, to, chain): from..to, places in the last level of ``chain``, as places in the level above, whose key is ``up``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last = [], []
            for chain, x, y in zip(b.column("chain"), b.column("from").to_pylist(), b.column("to").to_pylist(), strict=True):
                level = chain[-1].as_py()
                for out, at in ((first, x), (last, y - 1)):
                    _, _, window, offset = next(_pieces(level["segments"], at, 1))
                    out.append(window * level["size"] + offset)
            names = ["queue", "part", "begin", "up", "chain"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(first, pa.int64()), pa.array([x + 1 for x in last], pa.int64())], [*names, "from", "to"])

    out = rows.select("queue", "part", "begin", "up", "chain", "from", "to").mapInArrow(run, f"queue string, part int, begin long, up string, chain {_CHAIN}, from long, to long")
    return out.withColumnRenamed("up", "key")


def _chains(parts: DataFrame, keys: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Of parts (queue, part, n, begin): what of the schedules their tokens need, from their own level to the last."""
    rows = parts.select("queue", "part", "begin", F.col("queue").alias("key"), F.col("begin").alias("from"), (F.col("begin") + F.col("n")).alias("to"), F.array().cast(_CHAIN).alias("chain"))
    level = 0
    while True:
        plans, above = _level(keys, size)
        plans = scratch.save(plans, f"plans{level}")
        needed = lambda s: (s["before"] < F.col("to")) & (s["before"] + s["per"] * s["cycles"] > F.col("from"))
        link = F.struct(F.col("size"), F.filter("segments", needed).alias("segments"))
        rows = rows.join(plans, "key").withColumn("chain", F.concat("chain", F.array(link))).drop("size", "segments")
        if above is None:
            return scratch.save(rows.select("queue", "part", "begin", "chain"), "begins")
        rows, keys, level = scratch.save(_ranges(rows), f"rows{level}"), scratch.save(above, f"keys{level}"), level + 1


def pack(docs: DataFrame, proportions: dict[str | None, float] | None = None, tokenizer: str = tokens.TOKENIZER, size: int = WINDOW) -> DataFrame:
    """One row per piece. ``proportions``: target share of tokens by source, while it lasts; without it, each source's own share."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ids = scratch.save(encoded(docs, tokenizer), "ids")
    parts = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    parts = scratch.save(parts.withColumn("begin", F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")), "parts")
    keys = parts.groupBy(F.col("queue").alias("key")).agg(F.sum("n").alias("n"))
    if proportions:
        told = spark.createDataFrame([("null" if k is None else f"s{k}", float(v)) for k, v in proportions.items()], "key string, target double")
        keys = keys.join(told, "key", "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    else:
        keys = keys.withColumn("target", F.col("n").cast("double"))
    begins = _chains(parts, scratch.save(keys, "keys"), size, scratch)
    held = F.aggregate("chain", F.lit(64).cast("long"), lambda acc, c: acc + F.size(c["segments"]) * F.lit(64 + 16 * CYCLE))
    if (begins.agg(F.sum(held)).head()[0] or 0) <= BROADCAST:
        begins = F.broadcast(begins)
    width = tokens.width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts.small(batches, "ids", tokens.BATCH):
            rows, out = [], ([], [], [], [], [], [])
            keys = zip(b.column("queue").to_pylist(), b.column("part").to_pylist(), strict=True)
            chains = {}
            for i, (key, raw, at) in enumerate(zip(keys, b.column("ids"), b.column("at").to_pylist(), strict=True)):
                if key not in chains:
                    chains[key] = b.column("chain")[i].as_py()
                wide = np.frombuffer(raw.as_py(), f"<u{width}").astype("<u4").data.cast("B")
                n = len(wide) // 4
                for begin, length, window, offset in _placed(chains[key], at, n):
                    rows.append(i)
                    for x, v in zip(out, (begin, length, zlib.crc32(wide[4 * begin : 4 * (begin + length)]), n, window, offset), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in out)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    placed = ids.join(begins, ["queue", "part"]).select("doc_id", "queue", "part", "ids", (F.col("begin") + F.col("start_in_part")).alias("at"), "chain")
    kind = ids.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
