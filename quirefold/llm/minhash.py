"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its runs of five words, each weighted by how often it
occurs; the similarity of two documents is the weighted Jaccard index (sum of minima by
sum of maxima). Every element owns the region [0, weight) x [0, theta] of a plane, and a
Poisson process seeded by the element's hash throws darts into it: cells of the plane
are dyadic in weight and in rank, so documents that share an element see the same darts
where their regions overlap. Each dart falls on one of `k` coordinates; the dart of
least rank on a coordinate is the signature's value there. Theta is the expected number
of darts by the document's weight, and is doubled for documents that leave a coordinate
empty. Cost follows the number of elements plus about k ln k darts, not their product.

Signatures are banded. A bucket (equal band) links its members to its least member, never
all pairs. Links are verified by the exact similarity of the two whole texts; connected
components give classes. In a bucket that then still holds several classes, the members
outside its largest class are compared exactly with every member of another class, in
tiles of bounded size, so a centre that is unlike some members loses no link among them;
a tile returns one link for each two classes that it joins. Exact copies are joined by
the digest of the text before all this.

Defined results: a text without a word (null, empty, only spaces) is in a class of its
own. A text of fewer than five words is one element. Rows with one id are one document;
a null id has a null class. The class id is the least id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint
from . import vector
from .cluster import components

_U = np.uint64
_HASHER = vector.WordHasher("space")
#: Rank levels: level 0 is [0, 2**-LOW), level j is [2**(j-1-LOW), 2**(j-LOW)).
LOW = 6
#: Bounds of each side of a tile of exact comparisons.
TILE_ROWS, TILE_BYTES, TILE_COLUMNS = 512, 4 << 20, 2048


@lru_cache(maxsize=256)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    out, p, total, n = [], math.exp(-area), 0.0, 0
    while total < 1 - 1e-12 and n < 40 + 4 * area:
        total += p
        out.append(total)
        n += 1
        p *= area / n
    return np.array(out)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def elements(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their counts; rows ascend."""
    key = vector.mix(hashes + rows.astype(np.uint64) * _U(0x9FB21C651E98DF25))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(key)))
    at = order[begin]
    back = np.argsort(at, kind="stable")
    return hashes[at[back]], rows[at[back]], count[back].astype(np.float64)


def dart_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, k: int, seed: int = 1) -> np.ndarray:
    """(n_rows, k) signatures of the weighted sets; rows without an element keep zeros."""
    total = np.bincount(row, weights=weight, minlength=n_rows)
    expected = k * math.log(k) + 2 * k
    theta = np.divide(expected, total, out=np.zeros(n_rows), where=total > 0)
    # one entry for each weight cell that an element reaches: [0,1), [1,2), [2,4), [4,8), ...
    cells = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    which = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    base = vector.mix(element[which] + (cell.astype(np.uint64) + _U(seed)) * _U(0xE7037ED1A0B428DB))
    own, reach = row[which], weight[which]
    out = np.zeros((n_rows, k), dtype=np.uint64)
    todo = total > 0
    while todo.any():
        alive = todo[own]
        found_key, found_value = [], []
        for level in range(0, LOW + 2 + max(0, math.ceil(math.log2(theta[todo].max())))):
            low, high = (0.0, 2.0**-LOW) if not level else (2.0 ** (level - 1 - LOW), 2.0 ** (level - LOW))
            at = np.flatnonzero(alive & (theta[own] > low))
            if not len(at):
                break
            u = vector.mix(base[at] + _U((level + 1) * 0x8EBC6AF09C88C6E3 % 2**64))
            for c in np.unique(cell[at]):
                here = cell[at] == c
                start, width = (0.0, 1.0) if not c else (2.0 ** (c - 1), 2.0 ** (c - 1))
                n = np.searchsorted(_poisson(width * (high - low)), _unit(u[here]), side="right")
                some = n > 0
                n = n[some]
                src = np.repeat(at[here][some], n)
                nth = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
                dart = vector.mix(np.repeat(u[here][some], n) + (nth.astype(np.uint64) + _U(1)) * _U(0x589965CC75374CC3))
                rank = low + (high - low) * _unit(dart)
                place = vector.mix(dart ^ _U(0xA5A5A5A5A5A5A5A5))
                keep = (rank <= theta[own[src]]) & (start + width * _unit(vector.mix(place)) < reach[src])
                src, rank, place = src[keep], rank[keep].astype(np.float32), place[keep]
                found_key.append(((own[src] * k + (place % _U(k)).astype(np.int64)).astype(np.uint64) << _U(32)) | rank.view(np.uint32).astype(np.uint64))
                found_value.append(place)
        key, value = np.concatenate(found_key), np.concatenate(found_value)
        order = np.argsort(key, kind="stable")
        slot = (key[order] >> _U(32)).astype(np.int64)
        new = np.ones(len(slot), dtype=bool)
        new[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[new]] = value[order][new] | _U(1)
        todo = todo & (out == 0).any(axis=1)
        theta = theta * 2
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of n words; a shorter text that has words is one run."""
    starts, ends, row = _HASHER.spans(data, offsets)
    words = _HASHER.hashes(data, starts, ends)
    h, at = vector.grams(words, row, n)
    rows = row[at]
    per = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((per > 0) & (per < n))
    if len(few):
        first = np.searchsorted(row, few)
        acc = np.zeros(len(few), dtype=np.uint64)
        for j in range(n - 1):
            more = per[few] > j
            acc[more] = vector.mix(acc[more] + words[first[more] + j] + _U(j + 1))
        h, rows = np.concatenate([h, acc]), np.concatenate([rows, few])
    return h, rows


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.reshape(-1), kind))


def signatures(texts: DataFrame, n_words: int = 5, bands: int = 16, rows: int = 4) -> DataFrame:
    """Columns id, key and text -> id, key, buckets array<long>, size long (bytes); texts without words are left out."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vector.buffers(batch.column(2))
            for i, j in vector.ranges(offsets):
                h, row = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
                some = np.flatnonzero(np.bincount(row, minlength=j - i))
                part = batch.slice(i, j - i).take(pa.array(some))
                if not len(some):
                    continue
                sig = dart_minhash(*_renumbered(h, row, some), len(some), k)
                bucket = np.zeros((len(some), bands), dtype=np.uint64)
                for r in range(rows):
                    bucket = vector.mix(bucket + sig[:, r::rows] + np.arange(bands, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))
                size = np.diff(offsets[i : j + 1])[some]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _list(bucket.view(np.int64), pa.int64()), pa.array(size)], names=["id", "key", "buckets", "size"])

    return vector.map_batches(texts.select("id", "key", "text"), run, "id long, key binary, buckets array<long>, size long")


def _renumbered(h: np.ndarray, row: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return elements(h, np.searchsorted(some, row))


def similar(pairs: DataFrame, n_words: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """Of rows (a, b, text_a, text_b), the pairs whose exact similarity is numerator/denominator or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (vector.buffers(batch.column(c)) for c in (2, 3))
            for i, j in vector.ranges(left[1] + right[1], 2 * vector.CHUNK_BYTES):
                coded = []
                for data, off in (left, right):
                    h, row = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], n_words)
                    coded.append(elements(h, row))
                same = np.zeros(j - i)
                tag = [vector.mix(h + r.astype(np.uint64) * _U(0x9FB21C651E98DF25)) for h, r, _ in coded]
                order = [np.argsort(t) for t in tag]
                a, b = (t[o] for t, o in zip(tag, order))
                at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                hit = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, dtype=np.int64)
                least = np.minimum(coded[0][2][order[0][hit]], coded[1][2][order[1][at[hit]]])
                same = np.bincount(coded[0][1][order[0][hit]], weights=least, minlength=j - i)
                total = sum(np.bincount(r, weights=w, minlength=j - i) for _, r, w in coded) - same
                ok = np.flatnonzero((total > 0) & (denominator * same >= numerator * total))
                part = batch.slice(i, j - i).take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return vector.map_batches(pairs.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, bands: int = 16, rows: int = 4, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """(id, class_id, is_kept) for each document; similarity is numerator/denominator, 0.8, or more within links.

    With 16 bands of 4 a link at 0.8 shares no bucket with probability (1 - 0.8^4)^16,
    about 2 in 10,000, and less above. Shuffles: digests, signatures of distinct texts,
    and the texts once, by id, for the exact checks.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = base.where("id is not null and text is not null")
    keyed = known.withColumn("key", F.unhex(F.md5("text")))
    nodes = checkpoint(signatures(keyed, n_words, bands, rows).groupBy("key").agg(F.min("id").alias("node"), F.first(F.struct("buckets", "size")).alias("s")).select("key", "node", "s.*"))
    members = nodes.select("node", F.explode("buckets").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("bucket", "a")
    shared = checkpoint(members.join(centres, "bucket").where("node > a"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Texts meet their pairs: those of the members first, then those of the centres."""
        first = pairs.join(known.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        both = first.join(known.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        return checkpoint(similar(both, n_words, numerator, denominator).distinct())

    links = verified(shared.select("a", F.col("node").alias("b")).distinct())
    classes = components(links)
    more = checkpoint(_across(shared, classes, nodes, known, n_words, numerator, denominator))
    if not more.isEmpty():
        classes = components(links.union(more))
    ids = base.select("id", F.unhex(F.md5("text")).alias("key")).distinct()
    named = ids.join(nodes.select("key", "node"), "key", "left").join(classes, "node", "left")
    out = named.groupBy("id").agg(F.min(F.coalesce("component", "node", "id")).alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("is_kept"))


def _across(shared: DataFrame, classes: DataFrame, nodes: DataFrame, known: DataFrame, n_words: int, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) between different classes of one bucket."""
    members = shared.select("bucket", "node").union(shared.select("bucket", F.col("a").alias("node")).distinct())
    members = members.join(classes, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("own"))
    mixed = members.groupBy("bucket").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("bucket")
    members = checkpoint(members.join(mixed, "bucket").join(nodes.select("node", "size"), "node"))
    largest = members.groupBy("bucket", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).groupBy("bucket").agg(
        F.max_by("own", F.struct("n", "own")).alias("main"), F.max(F.struct("n", "own", "size")).alias("m"), F.sum("n").alias("n"), F.sum("size").alias("size")
    )

    def tiles(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / TILE_ROWS), F.ceil(size / TILE_BYTES), F.lit(1)).cast("int")

    cut = largest.select("bucket", "main", tiles(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("n_left"), tiles(F.col("n"), F.col("size")).alias("n_right"))
    put = members.join(cut, "bucket")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = put.where("own <> main").select("bucket", "node", "own", F.lit(True).alias("is_left"), mine("n_left").alias("i"), every("n_right").alias("j"))
    right = put.select("bucket", "node", "own", F.lit(False).alias("is_left"), every("n_left").alias("i"), mine("n_right").alias("j"))
    texts = known.select(F.col("id").alias("node"), "text")

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        side = tile["is_left"].to_numpy()
        node, own = tile["node"].to_numpy(), tile["own"].to_numpy()
        h, row = [], []
        data, offsets = vector.buffers(tile["text"])
        for i, j in vector.ranges(offsets):
            x, r = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
            x, r, n = elements(x, r)
            n = n.astype(np.int64)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h.append(vector.mix(np.repeat(x, n) + nth.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)))
            row.append(np.repeat(r, n) + i)
        h, row = np.concatenate(h), np.concatenate(row)
        total = np.bincount(row, minlength=len(node))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        place = np.empty(len(node), dtype=np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        column = np.unique(h, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        same = np.zeros((len(a), len(b)), dtype=np.float32)
        for first in range(0, int(column.max(initial=-1)) + 1, TILE_COLUMNS):
            at = slice(*np.searchsorted(column, [first, first + TILE_COLUMNS]))
            c, r = column[at] - first, row[at]
            x, y = np.zeros((len(a), TILE_COLUMNS), dtype=np.float32), np.zeros((len(b), TILE_COLUMNS), dtype=np.float32)
            x[place[r[side[r]]], c[side[r]]] = 1
            y[place[r[~side[r]]], c[~side[r]]] = 1
            same += x @ y.T
        i, j = np.nonzero(denominator * same >= numerator * (total[a][:, None] + total[b][None, :] - same))
        i, j = a[i], b[j]
        i, j = i[own[i] != own[j]], j[own[i] != own[j]]
        pair = np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])], axis=1)
        once = np.unique(pair, axis=0, return_index=True)[1] if len(pair) else np.zeros(0, dtype=np.int64)
        return pa.table({"a": pa.array(node[i[once]], pa.int64()), "b": pa.array(node[j[once]], pa.int64())})

    return left.union(right).join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()
