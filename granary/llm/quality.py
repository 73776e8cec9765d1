"""Rule-based quality filter: one threshold table compiled into one projection.

Every metric is a built-in expression over the whole text, so the filter runs in
the JVM inside the scan stage: no user functions, no shuffle.

Defined results: a null or empty text has no words and fails; rows are judged one
by one, so repeated rows get equal verdicts; a null language only switches off the
stop-word rule; other columns are passed through untouched by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8

STOP_WORDS = {
    "en": "the be to of and that have with is in it for as this are or was by on at from an a not",
    "fr": "le la les de des du un une et est en que qui dans pour par sur avec ce il au pas plus ou",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem es im an als auch er",
    "es": "el la los las de del un una y es en que por para con se no su al lo como más o a",
}


@dataclass(frozen=True)
class Rule:
    """Keeps a document if ``low <= metric <= high``; a missing metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Ratios are per word or per line that holds a word.
RULES = (
    Rule("n_words", low=20),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbol_ratio", high=0.3),
    Rule("stop_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.5),
)


def _stop_words() -> list[str]:
    lower = {w for words in STOP_WORDS.values() for w in words.split()}
    return sorted(lower | {w.capitalize() for w in lower})


def _repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash, made of the hashes of two halves, these of
    two quarters and so on down to the words. Start positions
    of windows equal to a neighbour in hash order are sorted; each covers 8 words
    less what the one before it covers, so the cost is n log n for any text.
    """
    step = lambda k: lambda p: F.transform(p, lambda h, i: F.xxhash64(h, F.get(p, i + k)))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])
            return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(at, k - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(pairs, positions), total)

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    def windows(one: Column) -> Column:
        eight = let(let(let(one, step(1)), step(2)), step(4))
        return let(F.slice(eight, F.lit(1), F.size(one) - (WINDOW - 1)), of)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def metrics(text: Column, lang: Column | None = None) -> Column:
    """One struct with the counts of the contract and the ratios that the rules name."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(rf"[^{SPACE[1:]}"))
    words = F.filter(F.split(whole, SPACE + "+"), lambda w: w != "")
    share = lambda part, of: F.when(of > 0, part / of)

    stop_words = _stop_words()

    def over_words(w: Column) -> Column:
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.octet_length(whole) - F.octet_length(F.regexp_replace(whole, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
            _repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stop_words))).cast("long").alias("n_stop_words"),
        )
        return let(counts, lambda c: let(lines, lambda x: over_lines(c, x)))

    def over_lines(c: Column, x: Column) -> Column:
        n_lines = F.size(x).cast("long")
        dup = (n_lines - F.size(F.array_distinct(x))).cast("long")
        return F.struct(
            *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")),
            dup.alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            share(c["word_chars"], c["n_words"]).alias("mean_word_chars"),
            share(c["n_symbols"], c["n_words"]).alias("symbol_ratio"),
            (F.lit(None) if lang is None else F.when(lang.isin(*STOP_WORDS), share(c["n_stop_words"], c["n_words"]))).cast("double").alias("stop_ratio"),
            share(dup, n_lines).alias("dup_line_ratio"),
            share(F.size(F.filter(x, lambda y: y.rlike(rf"^{SPACE}*[-*•]{SPACE}"))), n_lines).alias("bullet_line_ratio"),
            share(F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…){SPACE}*\z"))), n_lines).alias("ellipsis_line_ratio"),
        )

    return let(words, over_words)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the base test and every rule of the table pass."""
    ok = ~base_failed(m)
    for r in rules:
        if r.low is not None:
            ok = ok & F.coalesce(m[r.metric] >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(m[r.metric] <= r.high, F.lit(True))
    return ok


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the metrics, base_failed and kept, for every row of ``docs``."""
    lang = F.col("lang") if "lang" in docs.columns else None
    m = F.col("__m")
    scored = docs.select(F.col("doc_id"), metrics(F.col("text"), lang).alias("__m"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ratios = ("mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio")
    return scored.select(
        "doc_id", *(m[k].alias(k) for k in names), base_failed(m).alias("base_failed"), verdict(m, rules).alias("kept"),
        *(F.round(m[k], 6).alias(k) for k in ratios),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    lang = F.col("lang") if "lang" in docs.columns else None
    return docs.filter(let(metrics(F.col("text"), lang), lambda m: verdict(m, rules)))
