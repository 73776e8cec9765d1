"""Small tables for the corpus operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def rows(texts: list[str | None], first: int = 1) -> list[tuple]:
    return [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts: list[str | None], first: int = 1):
    return spark.createDataFrame(rows(texts, first), DOCS)


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def overlapping(seed: int = 3, n: int = 40) -> list[str | None]:
    """Texts that share passages in every way: copies, near copies, shared parts, runs of one word, null, empty."""
    rng = random.Random(seed)
    pool = [prose(1000 + i, rng.randrange(8, 60), 60) for i in range(12)]
    out: list[str | None] = [None, "", " \n ", "a " * 300, "a " * 40, "é" * 90, "x" + "é" * 60]
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else prose(i * 7 + k, rng.randrange(1, 50), 60) for k in range(rng.randrange(1, 6))]
        text = rng.choice([" ", "\n", "  "]).join(parts)
        if rng.random() < 0.3:
            w = text.split(" ")
            w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        out.append(text)
    return out + out[10:14] + [out[7]]
