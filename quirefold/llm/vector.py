"""NumPy kernels shared by the operators that read whole texts from Arrow batches.

Texts stay in Arrow's own layout (one byte buffer and an offset for each row), so a
batch costs a fixed number of array passes and no Python object for each word. Work
is cut into row ranges of about ``CHUNK_BYTES``; a text longer than that is a range
of its own, so that memory follows the longest text and never the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply), on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _letter_table(fold_ascii: bool, salt: int) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE) + _U(salt))
    if fold_ascii:
        table[65:91] = table[97:123]
    return table


def separators(kind: str) -> np.ndarray:
    """256 flags: which bytes end a word.

    ``space``: U+0020 and U+0009 to U+000D. ``alnum``: every ASCII byte that is no
    letter or digit; bytes of other scripts always belong to words.
    """
    flags = np.zeros(256, dtype=bool)
    if kind == "space":
        flags[[32, 9, 10, 11, 12, 13]] = True
    elif kind == "alnum":
        flags[:128] = True
        for a, b in ((48, 58), (65, 91), (97, 123)):
            flags[a:b] = False
    else:
        raise ValueError(kind)
    return flags


class WordHasher:
    """64-bit hashes of all words of a buffer in a few array passes."""

    def __init__(self, kind: str = "space", fold_ascii: bool = False, salt: int = 0):
        self.stops = separators(kind)
        self.table = _letter_table(fold_ascii, salt)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of each word; words never cross rows."""
        inside = ~self.stops[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        if len(data):
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        per_row = np.diff(np.searchsorted(starts, offsets))
        return starts, ends, np.repeat(np.arange(len(offsets) - 1), per_row)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word, whatever its place; a very long text is taken in pieces, for the sake of memory."""
        if len(data) <= 2 * CHUNK_BYTES:
            return self._hashes(data, starts, ends)
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
            first = starts[i]
            out[i:j] = self._hashes(data[first : ends[j - 1]], starts[i:j] - first, ends[i:j] - first)
            i = j
        return out

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n hashes, by doubling: a run of a + b is made of one of a and the one of b after it."""
    out, size, block, width = None, 0, words, 1
    while True:
        if n & width:
            last = len(words) - size - width + 1
            out = block[:last].copy() if out is None else out[:last] * _power(width) + block[size : size + last]
            size += width
        if size == n:
            return mix(out + _U(n))
        last = len(words) - 2 * width + 1
        block, width = block[:last] * _power(width) + block[width : width + last], 2 * width


def _power(n: int) -> np.uint64:
    return _U(pow(int(_GRAM), n, 1 << 64))


def grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and the index of each run's first word."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(rows[: len(words) - n + 1] == rows[n - 1 :])
    return runs(words, n)[at], at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n or off is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes of an Arrow batch sent to Python, unless the session sets its own bound.
BATCH_BYTES = 4 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`df.mapInArrow`, with batches bounded by their bytes and not by their rows alone.

    The bound is a setting of the session, read when the plan runs; a session that has
    one keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BOUND, None) is None:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column one by one; null counts as the empty text."""
    for value in column:
        yield value.as_py() or ""


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + length] for each pair."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.arange(total) + np.repeat(shift, lengths)]


def binary_array(data: np.ndarray, offsets: np.ndarray, text: bool = False) -> pa.Array:
    """An Arrow binary (or string) array over a byte array."""
    kind, width = (pa.large_string() if text else pa.large_binary(), np.int64) if offsets[-1] > 2**31 - 1 else (pa.string() if text else pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(width))), pa.py_buffer(np.ascontiguousarray(data))])


def fresh(df, *names: str) -> list[str]:
    """Column names like `names` that `df` does not use yet, whatever their case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
