"""Decontamination against a plain search for every window."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import decontam

from .fixtures import SF, frame, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for k, text in items:
        w = words(text)
        m = min(8, len(w))
        for i in range(len(w) - m + 1) if m and k is not None else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = []
    for k, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if items_ := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= items_
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def test_driver_documents(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert sorted((tuple(r) for r in decontam.score(docs, bench).collect()), key=str) == want
    assert any(r[2] for r in want)


PART = st.lists(st.sampled_from(["a", "b", "C", " ", "-", "9", "é", " ", "\x7f", "one two ", "a b a b a b a b a "]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(PART, min_size=1, max_size=4), st.lists(PART, min_size=1, max_size=5))
def test_random_texts(texts, items):
    pairs = list(enumerate(items))
    found = decontam.searchers([(str(k), t.encode()) for k, t in pairs])
    for want in brute(list(enumerate(texts)), pairs):
        n, ranges, names = decontam.scan(texts[want[0]].encode(), found)
        assert (n, sum(b - a for a, b in ranges), len(names)) == want[1:4]


def test_edges(spark, monkeypatch):
    passage = prose(1, 20)
    texts = [None, "", passage, f"x {passage} y", passage.upper().replace(" ", "-"), prose(2, 200_000, 90_000) + " " + passage, "short one", passage]
    items = [(1, passage), (1, passage), (2, passage[20:]), (3, "short one"), (4, None), (None, passage), (5, "..."), (6, "")]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    want = brute(list(enumerate(texts, 1)), [i for i in items if i[0] is not None])
    assert sorted((tuple(r) for r in decontam.score(docs, bench).collect()), key=str) == want
    assert decontam.score(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.score(docs.limit(0), bench).count() == 0
    monkeypatch.setattr(decontam, "GROUP_BYTES", 60)  # several groups of items
    assert sorted((tuple(r) for r in decontam.score(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(decontam, "_CHUNK", 256)
    found = decontam.searchers([("1", passage.encode())])
    assert decontam.scan(texts[5].encode(), found)[1] == [(200_000, 200_020)]


def test_decontaminate_removes_and_cuts(spark):
    one, two = prose(11, 12), prose(12, 12)
    bench = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    texts = [f"start {one} end", f"a {one} b {two} c", "clean text, as it is.", None]
    docs = frame(spark, texts)
    out = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1]["text"].split() == ["start", "end"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[3]["text"] == texts[2] and out[4]["text"] is None
    assert decontam.decontaminate(docs, bench).columns == docs.columns
