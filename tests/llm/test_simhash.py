"""SimHash against a plain version; linking against all pairs; one row of each group."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import simhash

from .fixtures import DOCS, SF, frame, prose


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps):
    """Least id reachable by links of two bits or fewer, by all pairs."""
    parent = {k: k for k, _ in fps}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k, _ in fps}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "é", "É", " ", "\n", "\x0b", " ", "Cd", "x"]), max_size=40).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_driver_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps = [(k, plain(t)) for k, t in rows]
    want = linked(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(df).collect()}
    assert got == {k: (f"{x:016x}", want[k]) for k, x in fps}


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_clustered_fingerprints_in_many_shards(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    xs = set(rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist())
    for c in centres.tolist():
        x = c
        for _ in range(30):  # chains of near neighbours
            x ^= 1 << int(rng.integers(64))
            if rng.random() < 0.7:
                x ^= 1 << int(rng.integers(64))
            xs.add(x)
    fps = [(i, x) for i, x in enumerate(sorted(xs))]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for _, x in fps], "fp long")
    links = simhash.links(df, 2, 100).collect()
    number = {(x - (1 << 64) if x >> 63 else x): i for i, x in fps}
    parent = {i: i for i, _ in fps}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in links:
        a, b = sorted((root(number[r["a"]]), root(number[r["b"]])))
        parent[b] = a
    assert {i: root(i) for i, _ in fps} == linked(fps)


def test_nulls_repeats_and_empty(spark):
    text = prose(1, 50)
    df = spark.createDataFrame([(5, text, "x"), (5, text, "x"), (9, text, "x"), (None, text, "x"), (3, None, "x"), (4, " ", "x"), (None, None, None)], "doc_id long, text string, fingerprint string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, 5), (3, 3), (4, 3), (None, 3)], key=str)
    assert simhash.components(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_group_with_thousands_of_copies(spark):
    copies = [prose(2, 60)] * 3000 + [prose(i, 40) for i in range(50)]
    got = simhash.components(frame(spark, copies)).collect()
    assert sum(r["component_id"] == 1 for r in got) == 3000
    kept = simhash.keep_one(frame(spark, copies)).collect()
    assert len(kept) == 51 and DOCS
