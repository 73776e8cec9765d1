"""Repeated strings against brute force: over words and over bytes."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from granary.llm import repeats, substring, suffix

from .fixtures import SF, frame, overlapping, prose


def brute(docs, units, length):
    """By row: whether each unit is covered by a window that also starts in a document with a smaller id."""
    first = {}
    for k, text in docs:
        u = units(text)
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length]
            first[w] = min(first.get(w, k), k)
    out = []
    for k, text in docs:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length]) if isinstance(u, list) else u[i : i + length]
            if first[w] < k:
                gone[i : i + length] = [True] * length
        out.append((k, u, gone))
    return out


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def expect_words(docs):
    return sorted((k, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for k, u, g in brute(docs, words, 13))


def expect_bytes(docs):
    out = []
    for k, u, g in brute(docs, lambda t: (t or "").encode(), 50):
        runs = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out.append((k, len(u), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_pieces(monkeypatch):
    """Many chunks and slices, as in a large corpus."""
    monkeypatch.setattr(repeats, "CHUNK", 700)
    monkeypatch.setattr(repeats, "SLICE", 256)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_texts(spark, seed):
    docs = list(enumerate(overlapping(seed), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(substring.digests(df)) == expect_words(docs)
    assert got(suffix.digests(df)) == expect_bytes(docs)


def test_slices_and_chunks(spark, small_pieces):
    docs = list(enumerate(overlapping(4), 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # workers import the modules anew, so the sizes are set there through the Kind's own process: run it here as well
    for kind, units, length in ((repeats.Kind(13, 6, substring.split, lambda x: x), words, 13), (repeats.Kind(50, 24, suffix.split, suffix._BYTES.__getitem__), lambda t: (t or "").encode(), 50)):
        assert _local(docs, kind) == [g for _, _, g in brute(docs, units, length)]
    assert df.count() == len(docs)


def _local(docs, kind, buckets=8):
    """The steps of ``covered`` in this process, in chunks of some documents."""
    import zstandard

    chunks = []
    for i in range(0, len(docs), 4):
        parts = [(t or "").encode() for _, t in docs[i : i + 4]]
        chunks.append(repeats.Chunk({"ids": [k for k, _ in docs[i : i + 4]], "sizes": [len(p) for p in parts], "body": zstandard.compress(b"".join(parts))}, kind))

    def exchange(entries):
        sent = [(c, b, n, body) for c, e in enumerate(entries) for b, n, body in e.packed()]
        told = [[] for _ in entries]
        for bucket in {b for _, b, _, _ in sent}:
            own = [(c, n, *repeats.unpacked(n, body)) for c, b, n, body in sent if b == bucket]
            status = repeats.judged(*(np.concatenate([x[i] for x in own]) for i in (2, 3, 4)))
            at = 0
            for c, n, *_ in own:
                told[c].append((bucket, zstandard.compress(status[at : at + n].tobytes())))
                at += n
        return told

    first = [c.anchors(buckets) for c in chunks]
    told = exchange([e for _, e in first])
    windows = [c.asked(found, e.verdicts(t), buckets)[1] for c, (found, e), t in zip(chunks, first, told)]
    told2 = exchange(windows)
    out = []
    for c, a, b in zip(chunks, told, told2):
        covered, at = c.covered({0: a, 1: b}, buckets).tolist(), 0
        for end in c.ends.tolist():
            out.append(covered[at:end])
            at = end
    return out


def test_driver_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(substring.digests(df)) == expect_words(docs)
    assert got(suffix.digests(df)) == expect_bytes(docs)


def test_long_text_and_hot_passage(spark):
    shared = prose(7, 40, 1000)
    texts = [f"{prose(i, 30, 5000)} {shared} {prose(i + 500, 5, 5000)}" for i in range(60)]
    texts += [prose(1, 60_000, 50_000), "pre " + prose(1, 60_000, 50_000)[:200_000]]
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(substring.digests(df)) == expect_words(docs)
    assert got(suffix.digests(df)) == expect_bytes(docs)


def test_nulls_ties_and_extra_columns(spark):
    text = prose(5, 30)
    rows = [(3, text, 1), (3, text, 1), (None, text, 2), (4, text + " more", 3), (1, None, 4), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    out = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.digests(df).collect()), key=str)
    assert out == sorted([(3, 30, 0), (3, 30, 0), (None, 30, 30), (4, 31, 30), (1, 0, 0), (None, 0, 0)], key=str)
    got_bytes = sorted(((r["doc_id"], r["n_removed"]) for r in suffix.digests(df).collect()), key=str)
    n = len(text)
    assert got_bytes == sorted([(3, 0), (3, 0), (None, n), (4, n), (1, 0), (None, 0)], key=str)


def test_empty_table(spark):
    df = frame(spark, []).limit(0)
    assert substring.digests(df).count() == 0
    assert suffix.digests(df).count() == 0


def test_the_textbook_form_of_prefix_doubling(spark):
    texts = overlapping(4, 30)
    df = frame(spark, texts).repartition(3)
    docs = [(i + 1, t) for i, t in enumerate(texts)]
    assert got(suffix.digests(df, suffix.by_sorting)) == expect_bytes(docs)
    twice = spark.createDataFrame([(1, "a" * 60), (1, "a" * 60), (None, "a" * 60), (2, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_removed"]) for r in suffix.digests(twice, suffix.by_sorting).collect()), key=str) == [(1, 0), (1, 0), (2, 0), (None, 60)]
