"""Byte-level BPE encoding and decoding over whole texts.

Pre-tokens of a batch are told apart once, and each unknown one is encoded in a
length-bucketed NumPy matrix: a row holds the token ids of one pre-token, every round
merges the leftmost pair of minimum rank in each row, and the matrix is compacted by
one column, since each row that is still in play has lost exactly one token. Pair
ranks come from an open-addressing hash table over packed pairs. Rows without a
mergeable pair leave the matrix.

Results are defined as follows. A null text encodes like the empty text: no ids and no
bytes. Repeated rows give repeated results. Any other columns of the input pass
through. Texts of any length are encoded whole; a single pre-token of more than
``LONG`` bytes is merged with a heap instead of the matrix (same result, O(n log n)).
Memory follows the longest text: batches are bounded by bytes, and known pre-tokens are
forgotten beyond a number of them or of their characters.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vector

LONG = 1024
#: Pre-tokens kept between batches, and characters of them; beyond either the memory starts anew.
CACHE, CACHE_CHARS = 200_000, 4 << 20
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint32(2**32 - 1)


class PairTable:
    """Hash table from (left id, right id) to the id of the merged token, which is its rank."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(8, int(len(pairs) * 4).bit_length())
        self.shift = np.uint32(32 - bits) if bits < 32 else np.uint32(0)
        self.mask = np.uint32((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint32)
        self.vals = np.full(1 << bits, _NONE, dtype=np.int32)
        slot = self._slot(pairs)
        rest = np.arange(len(pairs))
        while len(rest):
            s = slot[rest]
            free = self.keys[s] == _EMPTY
            first = np.zeros(len(rest), dtype=bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.keys[s[put]], self.vals[s[put]] = pairs[rest[put]], merged[rest[put]]
            rest = rest[~put]
            slot[rest] = (slot[rest] + np.uint32(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> self.shift

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.vals[slot], _NONE)
        rest = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint32(1)) & self.mask
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.vals[slot[rest[hit]]]
            rest = rest[~hit & (found != _EMPTY)]
        return out


class ByteBPE:
    """Encoder and decoder for one file of ranks (base64 token and rank a line)."""

    def __init__(self, vocab_path: str, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        with open(vocab_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("packed pairs need ids below 65536")
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for t, i in self.ranks.items():
            tokens[i] = t
        self.lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, merged = [], []
        get = self.ranks.get
        for t, i in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = get(t[:cut]), get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    merged.append(i)
        self.table = PairTable(np.array(keys, dtype=np.uint32), np.array(merged, dtype=np.int32))
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.n_ids = 0
        self.at: list[np.ndarray] = []

    # encoding of distinct pre-tokens

    def _matrix(self, m: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of bytes; all rows have the same length."""
        out: list[np.ndarray | None] = [None] * len(m)
        m = self.byte_ids[m]
        row = np.arange(len(m))
        if m.shape[1] > 1:
            rank = self.table.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while m.shape[1] > 1 and len(m):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(m)), best]
            done = value == _NONE
            if done.any():
                for r, ids in zip(row[done], m[done]):
                    out[r] = ids
                m, rank, row, best, value = (x[~done] for x in (m, rank, row, best, value))
                if not len(m):
                    break
            n, width = m.shape
            every = np.arange(n)
            m[every, best] = value
            keep = np.ones((n, width), dtype=bool)
            keep[every, best + 1] = False
            m = m[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), dtype=bool)
            keep[every, best] = False
            rank = rank[keep].reshape(n, width - 2)
            if width > 2:
                at = np.flatnonzero(best > 0)
                rank[at, best[at] - 1] = self.table.get(m[at, best[at] - 1], m[at, best[at]])
                at = np.flatnonzero(best < width - 2)
                rank[at, best[at]] = self.table.get(m[at, best[at]], m[at, best[at] + 1])
        for r, ids in zip(row, m):
            out[r] = ids
        return out  # type: ignore[return-value]

    def _heap(self, raw: bytes) -> np.ndarray:
        """The same merges for one very long pre-token."""
        tok = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n = len(tok)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.table.get(np.array(tok[:-1]), np.array(tok[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(ranks) if r != _NONE]
        heapq.heapify(heap)
        pair: list[int | None] = [*ranks, None]

        def look(i: int) -> None:
            j = right[i]
            pair[i] = None
            if j < n:
                r = int(self.table.get(np.array([tok[i]]), np.array([tok[j]]))[0])
                if r != _NONE:
                    pair[i] = r
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if tok[i] is None or pair[i] != r:
                continue
            j = right[i]
            tok[i], tok[j] = r, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            look(i)
            if left[i] >= 0:
                look(left[i])
        return np.array([t for t in tok if t is not None], dtype=np.int32)

    def pieces(self, raws: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(raws)
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            width = int(lengths[group[0]]) if len(group) else 0
            if width > LONG:
                for i in group:
                    out[i] = self._heap(raws[i])
            elif width:
                step = max(1, (1 << 20) // width)
                for k in range(0, len(group), step):
                    part = group[k : k + step]
                    m = np.frombuffer(b"".join(raws[i] for i in part), dtype=np.uint8).reshape(len(part), width)
                    for i, ids in zip(part, self._matrix(m)):
                        out[i] = ids
        return out

    # texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if len(self.codes) > CACHE or self.chars > CACHE_CHARS:
            self._forget()
        codes, put = self.codes, self.codes.setdefault
        known = len(codes)
        flat = array("q")
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            before = len(flat)
            found = self.pattern.findall(t) if len(t) <= vector.CHUNK_BYTES else map(itemgetter(0), self.pattern.finditer(t))
            flat.extend(put(p, len(codes)) for p in found)
            counts[k] = len(flat) - before
        if len(codes) > known:
            fresh = [p.encode("utf-8", "surrogatepass") for p in islice(codes, known, None)]
            self.chars += sum(map(len, fresh))
            new = self.pieces(fresh)
            size = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            begin = self.n_ids + np.cumsum(size) - size
            total = self.n_ids + int(size.sum())
            if total > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(max(total, len(self.ids)), dtype=np.int32)])
            if new:
                self.ids[self.n_ids : total] = np.concatenate(new)
            self.n_ids = total
            self.at = [np.concatenate([self.at[0], begin]), np.concatenate([self.at[1], size])] if self.at else [begin, size]
        if not len(flat):
            return self.ids[:0], counts
        which = np.frombuffer(flat, dtype=np.int64)
        size = self.at[1][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        per_text = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        return vector.ragged(self.ids, self.at[0][which], size), per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and their offsets."""
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return vector.ragged(self.blob, self.starts[ids], size), ends[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def codec(vocab_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(vocab_path, pattern)


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, text_col: str = "text", decode: bool = True, check: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add `n_tokens` (long) and `token_ids` (binary: unsigned 32-bit little-endian ids).

    `decode` adds `decoded` (binary); `check` adds `decodes_back`, whether decoding gives
    the text's bytes again, without sending them back. `keep` names the columns of the
    input that pass through, by default all. One map-side pass without a shuffle.
    `vocab_path` names a rank file that every executor can open. Columns of the input with
    one of the names that are made are replaced.
    """
    kinds = {"n_tokens": T.LongType(), "token_ids": T.BinaryType()} | ({"decoded": T.BinaryType()} if decode else {}) | ({"decodes_back": T.BooleanType()} if check else {})
    made = list(kinds)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    if text_col not in docs.columns:
        raise ValueError(f"no column {text_col}")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, kinds[c]) for c in made])
    sent = [*keep, *([text_col] if text_col not in keep else [])]
    where = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path, pattern)
        for batch in batches:
            data, offsets = vector.buffers(batch.column(where))
            for i, j in vector.ranges(offsets):
                part = batch.slice(i, j - i)
                ids, counts = bpe.encode(list(vector.texts(part.column(where))))
                cols = [pa.array(counts), vector.binary_array(ids.astype("<u4").view(np.uint8), 4 * np.concatenate([[0], np.cumsum(counts)]))]
                if decode or check:
                    back, ends = bpe.decode(ids, counts)
                if decode:
                    cols.append(vector.binary_array(back, ends))
                if check:
                    at = offsets[i : j + 1]
                    cols.append(pa.array([np.array_equal(back[ends[k] : ends[k + 1]], data[at[k] : at[k + 1]]) for k in range(j - i)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *cols], names=[*keep, *made])

    return vector.map_batches(docs.select(*(docs[c] for c in sent)), run, schema)
