"""Packing: every id once, gapless windows, little padding, proportions."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import packing

from .fixtures import DOCS, SF, prose

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(docs, pieces, size=2048):
    """``docs``: (doc_id, text) with distinct ids."""
    ids = {k: ids_of(t) for k, t in docs}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for k, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[k])
            own = ids[k][at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p["length"]
        assert at == len(ids[k])
    short = 0
    for parts in by_window.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        short += at < size
    assert short <= 1
    total = sum(map(len, ids.values()))
    assert len(by_window) == -(-total // size)


def test_driver_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    check([(r["doc_id"], r["text"]) for r in df.collect()], packing.pack(df).collect())


def test_hot_source_nulls_and_long_text(spark):
    rows = [(i, prose(i, 20 + i % 50), "en", "hot" if i % 3 else f"s{i % 40}", None) for i in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, prose(5, 30_000), None, "long", None)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    check([(r[0], r[1]) for r in rows], packing.pack(df).collect())


def test_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3), (1, "a b", "s", 3), (None, "c", None, 1)], "doc_id long, text string, source string, offset int")
    got = packing.pack(df).collect()
    assert sorted((r["offset"], r["length"]) for r in got) in ([(0, 2), (2, 3), (5, 3)], [(0, 3), (3, 3), (6, 2)], [(0, 3), (3, 2), (5, 3)])
    assert packing.pack(df.limit(0)).count() == 0


def test_order_of_rows_alone_decides(spark):
    rows = [(i % 290, prose(i, 20 + i % 70) if i % 9 else None, "en", "hot" if i % 3 else f"s{i % 7}", None) for i in range(600)] + [(None, "x y", None, None, None)] * 3
    df = spark.createDataFrame(rows, DOCS)
    one, two, three = (sorted(map(tuple, packing.pack(packing.ordered(d)).collect()), key=str) for d in (df.repartition(3), df.repartition(7, "n_chars", "text"), df.orderBy("text").coalesce(1)))
    assert len(one) >= 603 and one == two == three
    assert packing.pack(packing.ordered(df.limit(0))).count() == 0


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 4)
    rows = [(i, prose(i, 30), "en", f"s{i % 30}", None) for i in range(200)]
    check([(r[0], r[1]) for r in rows], packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200_000), min_size=1, max_size=6), st.integers(0, 1000))
def test_schedule_serves_all_and_keeps_proportions(totals, seed):
    t = np.array(totals, np.int64)
    target = np.random.default_rng(seed).random(len(t)) + 0.05
    plan = packing.Schedule(t, target, 64)
    served = np.zeros(len(t), np.int64)
    for _, n, before, ends, _ in plan.segments:
        assert (before == served).all()
        takes = np.diff(ends, axis=0, prepend=0)
        assert (takes >= 0).all() and (takes.sum(1) <= 64).all()
        served += ends[-1] * n
    assert (served == t).all()
    first = plan.segments[0] if plan.segments else None
    if first is not None and first[1] > 1:  # queues last for whole cycles: shares hold within a window's rounding
        open_ = t > 0
        share = target * open_ / (target * open_).sum()
        assert np.abs(first[3][-1] / (64 * packing.CYCLE) - share).max() < 0.02
        assert np.abs(np.diff(first[3], axis=0, prepend=0) - 64 * share).max() <= 4


def test_proportions_of_windows(spark):
    rows = [(i, prose(i, 200), "en", "ab"[i % 2], None) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), {"a": 3.0, "b": 1.0}).collect()
    source = {r[0]: r[3] for r in rows}
    windows = defaultdict(lambda: defaultdict(int))
    for r in got:
        windows[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    early = [w for k, w in windows.items() if k < 20]
    assert all(abs(w["a"] - 1536) <= 8 for w in early)


def test_proportions_of_many_sources(spark):
    rows = [(i, prose(i, 150), "en", f"s{i % 300}", None) for i in range(600)]
    target = {f"s{k}": 3.0 if k < 100 else 1.0 for k in range(300)}
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), target).collect()
    check([(r[0], r[1]) for r in rows], got)
    source, tokens = {r[0]: r[3] for r in rows}, defaultdict(int)
    early = 12
    for r in got:
        if r["sequence_id"] < early:
            tokens[source[r["doc_id"]]] += r["length"]
    assert len(tokens) == 300
    for k, share in target.items():
        assert abs(tokens[k] - early * 2048 * share / 500) <= 16
