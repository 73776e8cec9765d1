"""Substring de-duplication by seed and extend over words.

Documents are joined on winnowed seeds of ``SEED`` words. A seed that two documents
share is extended both ways over all the windows that it anchors; where the extensions
agree, the whole stretch is a repeat, and where they part, single windows decide. What
is left of overlapping and adjacent windows are maximal repeats of at least ``WORDS``
words (see ``repeats``).

Defined results: words are runs of other than ASCII white space, unchanged; a null or
empty text has none; of repeated rows of one id none is smaller, so none goes for the
other; a null id is larger than any (2^63 - 1 counts as null); texts of any length are
searched whole; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, texts

WORDS, SEED = 13, 6
#: Distinct words whose ranks a worker holds.
HELD = 1 << 20


class _Ranks(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = r = xxhash.xxh64_intdigest(word)
        return r


_ranks = _Ranks()


def split(whole: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, ends, n = [], [], 0
    for text in whole:
        for piece in texts.pieces(text):
            words = piece.split()
            parts.append(np.fromiter(map(_ranks.__getitem__, words), np.uint64, len(words)))
            n += len(words)
        ends.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(ends, np.int64)


def _kept(chunk: repeats.Chunk, gone: np.ndarray) -> pa.Table:
    kept, n_words, n_removed, spans, at = [], [], [], [], 0
    for text, end in zip(chunk.texts, chunk.ends.tolist(), strict=True):
        own = gone[at:end]
        n_words.append(end - at)
        n_removed.append(int(np.count_nonzero(own)))
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
        spans.append([{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        out, last = [], 0
        words = text.split() if n_removed[-1] < end - at else []
        for a, b in zip(edges[::2], edges[1::2], strict=True) if words else ():
            out += words[last:a]
            last = b
        kept.append(b" ".join(out + words[last:] if edges else words))
        at = end
    pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.table(
        {"doc_id": pa.array(chunk.ids, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pairs)}
    )


def deduplicated(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, kept (words joined by spaces), n_words, n_removed, and the removed word spans, for every row of ``docs``."""
    kind = repeats.Kind(words, seed, split, lambda x: x)
    schema = "doc_id long, kept string, n_words long, n_removed long, spans array<struct<a: long, b: long>>"
    return repeats.covered(docs, kind, _kept, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
