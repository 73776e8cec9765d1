"""Personal data: base spans against plain patterns, weak supervision, redaction."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import pii

from .fixtures import SF, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in BASE.items()}


def expected(text):
    b = brute(text)
    spans = ",".join(f"{k}:{x}:{y}" for k in BASE for x, y in b[k])
    return (*(len(b[k]) for k in BASE), hashlib.sha256(spans.encode()).hexdigest(), spans)


def check(spark, texts):
    got = {r["doc_id"]: r for r in pii.digests(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts, 1):
        want, r = expected(t), got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want[:5], (t, r["spans"], want)
        assert r["spans"].startswith(want[5])
    return got


PIECES = ["a", "@", ".", "b1", "-", "_", "%", " ", "+1", "(555)", "123", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "\n", "é", "𝄞", "00", "x@y.zz", "++49 30 123456", "5500000000000004"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=30, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    check(spark, texts)


def test_driver_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [r["text"] for r in rows])


def test_edges(spark):
    many = " ".join(f"u{i}@mail.example.com" for i in range(3000))
    texts = [None, "", "a" * 4000, "1" * 4000, "1." * 4000, "a@b.c_d@e.f", "+" * 5000, "+1" + " " * 100_000 + "2", many, "-" * 4000 + "x@y.z", "a.b@" * 2000, "𝄞 +1 (663) 555-6869 𝄞 x@y.org"]
    check(spark, texts)
    assert pii.digests(frame(spark, []).limit(0)).count() == 0
    # texts on which the plain patterns take quadratic time
    long = pii.digests(frame(spark, ["a" * 500_000, "1" * 500_000, "-" * 500_000 + "x@y.z", "1.2.3.4 " * 30_000])).collect()
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"]) for r in long) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (4, 0, 30_000, 0)]


def test_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cc", 9), (1, "a@b.cc", 9), (None, "x", 9)], "doc_id long, text string, n_email int")
    rows = [tuple(r) for r in pii.digests(df).collect()]
    assert len(rows) == 3 and rows.count((1, 1, 0, 0, 0, *expected("a@b.cc")[4:])) == 2


def test_further_spans(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'some words token = "{token[i:] + token[:i]}" and more' for i in range(20)]
    texts += [f"call (663) 555-68{i:02} today" for i in range(20)] + [f"order 98079157628044{i:02} was sent" for i in range(20)] + ["Donaudampfschifffahrtsgesellschaft and so on"] * 20
    got = pii.digests(frame(spark, texts)).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    at = texts[0].index(token)
    assert spans[1] == f"secret:{at}:{at + 40}"
    assert spans[21] == "telephone:5:19"
    assert all("secret" not in spans[i] for i in range(61, 81))


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    y = rng.random(5000) < 0.4
    votes = np.stack([np.where(rng.random(5000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.9, 0.55)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, table = pii.expectation_maximisation(np.zeros(len(n), int), patterns, n.astype(float))
    assert table[0, 1, 2] > 0.9 and table[1, 1, 2] > 0.8 and abs(table[2, 1, 2] - 0.55) < 0.1
    of = {tuple(v): x for v, x in zip(patterns.tolist(), p, strict=True)}
    assert np.mean([(of[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), y, strict=True)]) > 0.93


def test_redaction(spark):
    texts = ["mail x@y.org or 1.2.3.4, card 4111 1111 1111 1111, +1 (663) 555-6869.", "clean text stays, 12 of 13.", None, "256.1.1.1 stays"]
    texts += [f'token = "04dbebab91ab85687d33eeaaf9ac699e1188f9{i:02}"' for i in range(10)]
    df = frame(spark, texts)
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert pii.redacted(df).schema.names == df.schema.names
    assert out[1]["text"] == "mail [EMAIL] or [IP], card [CARD], [PHONE]." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == texts[1] and out[3]["text"] is None and out[4]["text"] == texts[3]
    assert out[5]["text"] == 'token = "[SECRET]"'


def test_redaction_of_overlapping_base_spans(spark):
    """Only what no base span of the raw text covers stays."""
    texts = ["call +33 1.23.45.67.89 now", "or +49.30.12.34.56.78, and +1.2.3.4.5.6.7.8.9", "1.2.3.4@mail.example.org é", "mail a@b.org", "+1 4111111111111111 x@y.org", "+33 1.23.45.67.89" * 2, "plain", None]
    texts += ["".join(p) for k in range(60) for p in [np.random.default_rng(k).choice(PIECES, 14)]]
    got = {r["doc_id"]: r["text"] for r in pii.redacted(frame(spark, texts)).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 7, 8)] == ["call [PHONE] now", "or [PHONE], and [PHONE]", "[EMAIL] é", "mail [EMAIL]", "plain", None]
    for i, t in enumerate(texts, 1):
        held = {k for spans in brute(t).values() for a, b in spans for k in range(a, b)}
        left = iter("".join(c for k, c in enumerate(t or "") if k not in held))
        assert all(c in left for c in re.sub(r"\[[A-Z]+\]", "", got[i] or "")), (t, got[i])
