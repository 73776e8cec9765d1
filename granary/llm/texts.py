"""Whole texts in Arrow batches, as bytes, in pieces of bounded size; their words and the hashes of these in flat arrays."""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa

#: A text longer than this is walked in pieces cut at white space.
PIECE = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def raw(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def pieces(text: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """``text`` cut at ASCII white space into pieces of about ``limit`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > limit:
        m = _SPACE.search(text, at + limit)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def small(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts hold about ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_S = [np.uint64(x) for x in (30, 27, 31)]
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finish of splitmix64: one to one on 64 bits."""
    x = (x ^ (x >> _S[0])) * _M[1]
    x = (x ^ (x >> _S[1])) * _M[2]
    return x ^ (x >> _S[2])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b)."""
    return mixed(a * _M[0] + b)


def hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes, none zero, of parts of ``data``, which goes on for eight bytes after the last one."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = end - begin
    h = mixed((eight[begin] & _FIRST[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _M[0]))
    of, j = np.flatnonzero(n > 8), 8
    while len(of):
        h[of] = joined(h[of], eight[begin[of] + j] & _FIRST[np.minimum(n[of] - j, 8)])
        j += 8
        of = of[n[of] > j]
    return np.where(h == 0, _M[0], h)


def words(texts_: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts joined, begins and ends of their words (between ASCII white space), and the number of the text of each word."""
    data = b"\n" + b"\n".join(texts_) + b"\n" * 9
    white = _WHITE[np.frombuffer(data, np.uint8)]
    begin = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    at = np.cumsum([1, *(len(x) + 1 for x in texts_)])
    return data, begin, end, np.searchsorted(at, begin, "right") - 1
