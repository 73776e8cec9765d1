"""One row of each group of near copies, by 5-word shingles, against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import jaccard, simhash
from granary.llm.common import Scratch

from .fixtures import DOCS, SF, frame, overlapping, prose


def plain(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def kept(rows):
    """Ids that are the least of their component, by all pairs."""
    sets = [(k, plain(t)) for k, t in sorted(rows)]
    parent = {k: k for k, _ in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(k for k in parent if root(k) == k)


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split(" ")
    for k in rng.sample(range(len(w)), n):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def stage(spark, df):
    return corpus_pipeline.near_dedup(spark, df, SF)


def test_near_copies_of_four_fifths_are_linked(spark):
    base = prose(1, 400)
    near, far = edited(base, 2, 4), edited(base, 3, 40)
    assert kept([(1, base), (2, near), (3, far)]) == [1, 3]
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, [base, near, far])).collect()) == [1, 3]


@pytest.mark.parametrize("chunk", [1 << 10, 1 << 21])
def test_against_all_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    line = prose(9, 30)
    texts = overlapping() + [f"{line} {prose(50 + i, 60)} {line}" for i in range(40)] + [prose(70, n, 9) for n in range(1, 40)]
    hub = [prose(80 + i, 150) for i in range(2)]
    texts += [edited(hub[i % 2], 100 + i, 2 + i % 4) for i in range(70)]
    df = frame(spark, texts)
    want = kept([(i + 1, t) for i, t in enumerate(texts)])
    assert len(want) < len(texts) - 40
    assert sorted(r["doc_id"] for r in stage(spark, df).collect()) == want


def test_driver_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(r["doc_id"] for r in stage(spark, df).collect()) == kept(rows)


def test_repeated_ids_nulls_and_empty(spark):
    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (None, prose(1, 50)), (None, prose(3, 50)), (4, None), (5, ""), (6, "a b"), (7, "A  B")]
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["text"]) for r in stage(spark, df).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[4], rows[6]], key=str)
    assert stage(spark, df.limit(0)).count() == 0


def test_prefixes_of_like_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n = int(rng.integers(1, 40))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.r_[rng.permutation(x)[: rng.integers(0, n) + 1], rng.integers(0, 1 << 62, n // 6).astype(np.uint64)])
        kinds = {int(h): int(rng.integers(0, 9)) for h in np.union1d(x, y)}
        first = []
        for s in (x, y):
            at, n, most = jaccard.prefixes(np.zeros(len(s), np.int64), s, np.array([kinds[int(h)] for h in s], np.uint8))
            assert (n == len(s)).all()
            first.append(dict(zip(s[at].tolist(), most.tolist(), strict=True)))
        both = len(np.intersect1d(x, y))
        if 5 * both >= 4 * (len(x) + len(y) - both):
            meet = min(first[0].keys() & first[1].keys(), key=lambda h: (kinds[h], h))
            assert len(y) <= first[0][meet] and len(x) <= first[1][meet]


def test_counts_of_chunks_are_those_of_all():
    rng = np.random.default_rng(1)
    chunks = [np.sort(rng.integers(0, 1 << 64, 300, dtype=np.uint64)) for _ in range(5)]
    chunks = [np.sort(np.r_[c, chunks[0][:50], chunks[0][:9]]) for c in chunks]
    sent = [list(jaccard._sent(c, np.ones(len(c), np.int64), 40, 7)) for c in chunks]
    q = np.concatenate(chunks) >> np.uint64(24)
    want = {int(k): int(jaccard.kind_of(n)) for k, n in zip(*np.unique(q, return_counts=True), strict=True)}
    seen = {}
    for bucket in range(7):
        parts = [jaccard._told(e) for own in sent for k, e in own if k == bucket]
        kinds = jaccard._classes(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        seen |= dict(zip(np.concatenate([p[0] for p in parts]).tolist(), kinds.tolist(), strict=True))
    assert seen == want


def test_fingerprints_of_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (0, 1, 2, 0, 37, 500, 0)]
    got = simhash.of_sets(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets))
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x)) for x in sets]
    assert got.tolist() == want


def test_the_stage_goes_through_the_tree(spark, monkeypatch):
    """What the tree links needs no shingles in common buckets; what it can't reach is found all the same."""
    long = [prose(200 + i, 3000) for i in range(3)]
    texts = [*long, *(edited(t, 300 + i, 1) for i, t in enumerate(long)), prose(210, 400), edited(prose(210, 400), 310, 6)]
    rows, df = [(i + 1, t) for i, t in enumerate(texts)], frame(spark, texts)
    asked, links, entries = [], simhash.links, jaccard.entries
    monkeypatch.setattr(simhash, "links", lambda unique, radius: asked.append(radius) or links(unique, radius))
    assert kept(rows) == [1, 2, 3, 7] == sorted(r["doc_id"] for r in stage(spark, df).collect())
    assert asked == [simhash.RADIUS]
    monkeypatch.setattr(jaccard, "entries", lambda docs, scratch: entries(docs.limit(0), scratch))
    assert sorted(r["doc_id"] for r in stage(spark, df).collect()) == [1, 2, 3, 7, 8]


def test_the_tree_links_only_what_is_alike(spark):
    a, b, c = prose(220, 100), edited(prose(220, 100), 320, 1), prose(221, 100)
    rows = [(r, len(plain(t)), t, fp) for r, t, fp in ((1, a, 5), (2, b, 4), (3, c, 5), (4, prose(222, 100), 1 << 40), (5, "", 5))]
    df = spark.createDataFrame(rows, "row long, n long, text string, fp long")
    found = jaccard.by_tree(df.select("row", "fp"), df, Scratch(spark))
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
