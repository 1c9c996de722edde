"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters, digits and non-ASCII characters, with ASCII letters
folded to lower case. Runs of `min_match` tokens of the benchmark items are indexed by
rolling hash; documents that share such a seed with an item are tiled against it:
seeds on one diagonal join to maximal matches, the longest match whose tokens are all
unmarked is marked in both texts, what it overlaps is dropped or shortened, and so on
until no match of `min_match` tokens is left. The share of the item's tokens under
tiles is its coverage, whatever the order of the passages in the document; from
`coverage` on the document is contaminated.

The pass is map-side. Benchmark items are indexed in blocks of at most `block_bytes` of
text, whose index travels with the pass; a larger benchmark takes more passes over the
documents, each with one block, and no larger index.

Defined results: null and empty texts match nothing, and neither do items of fewer than
`min_match` tokens. Among items of equal coverage the least id is reported. Repeated
rows give repeated results; other columns pass through, and columns that bear the names
of results are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpoint
from . import vector

_U = np.uint64
_HASHER = vector.WordHasher("alnum", fold_ascii=True)
MADE = ("leak_item", "leak_coverage", "leak_items")


def tiles(doc_at: np.ndarray, item_at: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the starts of equal runs of `seed` tokens: (item start, document start, length)."""
    out = []
    i, j = np.asarray(doc_at), np.asarray(item_at)
    while len(i):
        order = np.lexsort((j, i - j))
        i, j = i[order], j[order]
        new = np.ones(len(i), dtype=bool)
        new[1:] = ((i - j)[1:] != (i - j)[:-1]) | (j[1:] != j[:-1] + 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(i))) + seed - 1
        best = size.max()
        placed: list[tuple[int, int]] = []
        for b in sorted(begin[size == best], key=lambda b: (j[b], i[b])):
            x, y = int(j[b]), int(i[b])
            if all(abs(x - p) >= best and abs(y - q) >= best for p, q in placed):
                placed.append((x, y))
                out.append((x, y, int(best)))
        free = np.ones(len(i), dtype=bool)
        for x, y in placed:
            free &= ((j + seed <= x) | (j >= x + best)) & ((i + seed <= y) | (i >= y + best))
        i, j = i[free], j[free]
    return out


class Index:
    """Seeds of one block of items."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        self.ids, self.seed = np.array(ids, dtype=np.int64), seed
        hashes, item, at, self.size = [], [], [], np.zeros(len(ids), dtype=np.int64)
        for k, t in enumerate(texts):
            data, offsets = vector.buffers(pa.array([t], pa.string()))
            starts, ends, row = _HASHER.spans(data, offsets)
            self.size[k] = len(starts)
            h, p = vector.grams(_HASHER.hashes(data, starts, ends), row, seed)
            hashes.append(h)
            at.append(p)
            item.append(np.full(len(h), k))
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int64)
        bits = max(16, (8 * len(self.keys)).bit_length())
        self.low = _U((1 << bits) - 1)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[self.keys & self.low] = True

    def find(self, data: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple[int, int, float]]:
        """(row, item, coverage) of each row and item with coverage `least` or more."""
        if not len(self.keys):
            return []
        starts, ends, row = _HASHER.spans(data, offsets)
        h, at = vector.grams(_HASHER.hashes(data, starts, ends), row, self.seed)
        maybe = np.flatnonzero(self.some[h & self.low])
        place = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == h[maybe]
        maybe, place = at[maybe[hit]], place[hit]
        # pairs whose item has too few seeds in the document are out before occurrences are multiplied
        least_seeds = np.ceil(least * self.size / self.seed - 1e-9)
        key = np.unique(row[maybe].astype(np.int64) * len(self.keys) + place)
        many = self.first[key % len(self.keys) + 1] - self.first[key % len(self.keys)]
        n_items = len(self.ids)
        pair, n_seeds = np.unique(np.repeat(key // len(self.keys), many) * n_items + self.item[vector.ragged(np.arange(len(self.item)), self.first[key % len(self.keys)], many)], return_counts=True)
        pair = pair[n_seeds >= least_seeds[pair % n_items]]
        some = np.isin(row[maybe], pair // n_items)
        maybe, place = maybe[some], place[some]
        many = self.first[place + 1] - self.first[place]
        which = vector.ragged(np.arange(len(self.item)), self.first[place], many)
        token = np.repeat(maybe, many)
        wanted = np.isin(row[token].astype(np.int64) * n_items + self.item[which], pair)
        token, which = token[wanted], which[wanted]
        owner, item, pos = row[token], self.item[which], self.at[which]
        out = []
        order = np.lexsort((pos, item, owner))
        owner, item, pos, token = owner[order], item[order], pos[order], token[order]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (item[1:] != item[:-1])) + 1
        for a, b in zip(np.append(0, cut), np.append(cut, len(owner))):
            if b > a:
                n = self.size[item[a]]
                if (1 + np.count_nonzero(np.diff(pos[a:b]))) * self.seed >= least * n:
                    share = sum(t[2] for t in tiles(token[a:b], pos[a:b], self.seed)) / n
                    if share >= least:
                        out.append((int(owner[a]), int(item[a]), share))
        return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, coverage: float = 0.5, block_bytes: int = 4 << 20
) -> DataFrame:
    """`docs` with leak_item (long, null if none), leak_coverage (double) and leak_items (long, how many items leak)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    keep = [c for c in docs.columns if c.lower() not in MADE]
    out = docs.select(*(docs[c] for c in keep), F.lit(None).cast("long").alias(MADE[0]), F.lit(0.0).alias(MADE[1]), F.lit(0).cast("long").alias(MADE[2]))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).orderBy("item").collect()
        if k:  # written, so that no more than one index is held
            out = checkpoint(out)
        out = _scan(out, keep.index(text_col), Index([r[0] for r in part], [r[1] for r in part], min_match), coverage)
    return out


def _scan(docs: DataFrame, where: int, index: Index, coverage: float) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vector.buffers(batch.column(where))
            found = defaultdict(list)
            for i, j in vector.ranges(offsets):
                for row, item, share in index.find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], coverage):
                    found[row + i].append((share, -int(index.ids[item])))
            n = batch.num_columns
            item, share, many = (batch.column(n - k).to_pylist() for k in (3, 2, 1))
            for row, all_ in found.items():
                if item[row] is not None:
                    all_.append((share[row], -item[row]))
                many[row] += len({x for _, x in all_}) - (item[row] is not None)
                share[row], item[row] = max(all_)
                item[row] = -item[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 3], pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(many, pa.int64())], names=batch.schema.names)

    return vector.map_batches(docs, run, schema)
