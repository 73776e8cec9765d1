"""Quality rules: the base metrics against plain Python, verdicts, filtering."""

from __future__ import annotations

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import quality

from .fixtures import SF, frame, prose

SPACE = "\x20\t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = [w for w in re.split(f"[{SPACE}]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def check(spark, texts):
    got = quality.score(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"] - 1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, texts[r["doc_id"] - 1]
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", " ", "\n", "\t", "\x0b", "é", "𝄞", " ", "#", "|", "the cat sat on the mat and ran ", "\n\n", "\r\n"]), max_size=60).map("".join), min_size=20, max_size=40))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_edges(spark):
    p = prose(1, 40)
    check(spark, [None, "", " \n\t ", "a " * 1000, p, f"{p}\n{p}", f"x {p} y {p[:60]} z", "line\nline\n line\n\nline", prose(2, 100_000, 50_000), "w" * 200_000, "#*$%&|<>" * 50])


def test_driver_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()
    check(spark, [r["text"] for r in rows])


def test_filter_keeps_columns_and_rows(spark):
    good = "the quick brown fox is in the house and it was not at home for the whole of that day. " * 1 + prose(3, 30)
    df = spark.createDataFrame([(1, good, "en", 5), (1, good, "en", 5), (2, "too short", "en", 5), (None, good, None, None)], "doc_id long, text string, lang string, n_words int")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1]
    assert quality.score(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_every_rule_can_reject(spark):
    base = [prose(9, 60)]
    for rule, text in (
        ("mean_word_chars", "a b " * 5 + " ".join(chr(97 + i % 26) for i in range(60))),
        ("symbol_ratio", " ".join(f"w{i} #" for i in range(30))),
        ("bullet_line_ratio", "\n".join(f"- w{i} x{i} y{i}" for i in range(20))),
        ("ellipsis_line_ratio", "\n".join(f"w{i} x{i} ..." for i in range(20))),
        ("dup_line_ratio", "\n".join(f"only {i % 3}" for i in range(3)) + "\n" + "\n".join(["only 1"] * 2) + "\n" + prose(4, 3)),
    ):
        only = tuple(r for r in quality.RULES if r.metric == rule)
        df = spark.createDataFrame([(1, text, None), (2, base[0], None)], "doc_id long, text string, lang string")
        scored = {r["doc_id"]: r for r in quality.score(df, only).collect()}
        assert scored[2]["kept"]
        assert not scored[1]["kept"], rule
    stop = tuple(r for r in quality.RULES if r.metric == "stop_ratio")
    df = spark.createDataFrame([(1, base[0], "en"), (2, base[0], "xx")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in quality.score(df, stop).collect()} == {1: False, 2: True}


def test_no_python_in_the_plan(spark):
    plan = quality.score(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
