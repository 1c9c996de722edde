"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is dealt by id into reference blocks of bounded size, and documents are parsed
greedily against the blocks, in two parts.

Against its own block: every window of `window` consecutive words of the block is indexed
with the place where the document of least id first has it. A factor starts at the first
window of a document whose text begins earlier, in a document of smaller id, and is
extended in the block's text, word by word, for as long as both texts agree. The windows
that cross the factor's end are looked up next, so no repeated window is lost between two
factors. Windows inside factors are settled and go no further.

Against all other blocks: only windows outside those factors are left, one row for each
and block. Most cannot occur elsewhere, and a cheap test says so: of the runs of
`window // 2 + 1` words in a window the one of least hash is its seed; equal windows have
equal seeds, and consecutive windows mostly share one. Blocks exchange their distinct
seeds; only windows whose seed another block has too are exchanged themselves, with their
id and place, and each gets the place of its first occurrence in a document of smaller
id. Runs of windows that follow one another there are factors too.

Every exchange is by a hash of text, a row for each distinct seed or window of a block, so
that rows grow with the input and a passage in a third of all documents costs a row for
each block and not for each document.

Defined results: a null or empty text has no words, no factors and the empty kept text.
Rows with the same id do not make one another duplicates; a null id counts as larger
than every other. Texts are parsed whole. Words are equal if two independent 64-bit hashes
are; windows of other blocks are if 96 bits made of both are, so at 10^13 windows a false
match is expected once in a thousand runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector

_LAST = np.int64(2**63 - 1)
_HASHERS = vector.WordHasher("space"), vector.WordHasher("space", salt=0x5851F42D4C957F2D)


class Block:
    """The documents of one block in the order of their ids: words, and the windows of `window` words."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int, whole: bool = True):
        own = ids.fill_null(int(_LAST)).to_numpy().astype(np.int64)
        order = np.argsort(own, kind="stable")
        self.window, self.ids, self.null = window, own[order], ids.is_null().to_numpy()[order]
        column = texts.combine_chunks()
        column = column.take(pa.array(order)) if len(order) else pa.array([], pa.string())
        self.data, self.offsets = vector.buffers(column)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for i, j in vector.ranges(self.offsets):
            base = self.offsets[i]
            data = self.data[base : self.offsets[j]]
            starts, ends, row = _HASHERS[0].spans(data, self.offsets[i : j + 1] - base)
            hashes = [h.hashes(data, starts, ends) for h in _HASHERS[: 1 + whole]]
            for part, x in zip(parts, (starts + base, ends + base, (row + i).astype(np.int32), np.stack(hashes))):
                part.append(x)
        small = np.int32 if len(self.data) < 1 << 31 else np.int64
        none = np.zeros(0, dtype=small)
        self.starts, self.ends = (np.concatenate(p).astype(small) if p else none for p in parts[:2])
        self.row = np.concatenate(parts[2]) if parts[2] else none.astype(np.int32)
        self.words = np.concatenate(parts[3], axis=1) if parts[3] else np.zeros((1 + whole, 0), dtype=np.uint64)
        self.first_word = np.searchsorted(self.row, np.arange(len(own) + 1))
        # the word at which each window starts
        last = max(0, len(self.row) - window + 1)
        self.at = np.flatnonzero(self.row[:last] == self.row[window - 1 :]).astype(small) if last else none

    def seeds(self) -> np.ndarray:
        """The seed of each window."""
        n = self.window // 2 + 1
        if not len(self.at):
            return np.zeros(0, dtype=np.uint64)
        least, span, width = vector.runs(self.words[0], n), 1, self.window - n + 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        rest = width - span
        return (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least)[self.at]

    def first_places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of each window, and the first window of the block that equals it."""
        one, two = (vector.runs(h, self.window)[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64) for h in self.words)
        order = np.argsort(one, kind="stable")
        first = _group_firsts(one[order], order)
        if not np.array_equal(two[first], two):  # windows that differ share the first hash
            order = np.lexsort((two, one))
            first = _group_firsts(one[order], order, two[order])
        return one, two, first

    def repeated(self, first: np.ndarray) -> np.ndarray:
        """The windows that a document of smaller id in the block has."""
        row = self.row[self.at]
        return np.flatnonzero(self.ids[row[first]] < self.ids[row])

    def factors(self, first: np.ndarray) -> list[tuple[int, int, int]]:
        """The greedy parse against the block itself: (first word, words, first word of the source)."""
        hits = self.repeated(first)
        if not len(hits):
            return []
        ends = self.first_word[1:]
        begin = self.at[hits]
        source = self.at[first[hits]]
        most = np.minimum(ends[self.row[begin]] - begin, ends[self.row[source]] - source).tolist()
        begin, source, out, k = begin.tolist(), source.tolist(), [], 0
        last = hits.tolist()
        while k < len(last):
            i, p = begin[k], source[k]
            size = self._agree(i, p, most[k])
            out.append((i, size, p))
            # windows that cross the factor's end come next
            after = last[k] + size - self.window + 1
            k = k + 1 if k + 1 < len(last) and last[k + 1] >= after else int(np.searchsorted(hits, after))
        return out

    def _agree(self, i: int, p: int, most: int) -> int:
        """How many words from i on, at most `most`, agree with those from p on."""
        size, step = self.window, 32
        while size < most:
            n = min(step, most - size)
            same = (self.words[:, i + size : i + size + n] == self.words[:, p + size : p + size + n]).all(axis=0)
            if not same.all():
                return size + int(same.argmin())
            size, step = size + n, 4 * step
        return size


def _group_firsts(key: np.ndarray, order: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """For each item, the first of its group; `key`, and `more`, are in `order`, which is stable."""
    if not len(key):
        return order
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    if more is not None:
        new[1:] |= more[1:] != more[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.repeat(order[begin], np.diff(np.append(begin, len(key))))
    return out


def block_seeds(block: Block) -> np.ndarray:
    """Distinct seeds of the block."""
    seeds = block.seeds()
    if not len(seeds):
        return seeds
    new = np.ones(len(seeds), dtype=bool)
    new[1:] = seeds[1:] != seeds[:-1]
    return np.unique(seeds[new])


def open_windows(block: Block, shared: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows outside the block's own factors whose seed is in `shared` (sorted), once each: hashes, id and place."""
    one, two, first = block.first_places()
    left = first == np.arange(len(first))
    left[block.repeated(first)] = False
    places = np.flatnonzero(left)
    if len(places) and len(shared):
        seeds = block.seeds()[places]
        at = np.minimum(np.searchsorted(shared, seeds), len(shared) - 1)
        places = places[shared[at] == seeds]
    else:
        places = places[:0]
    return one[places], two[places], block.ids[block.row[block.at[places]]], places


def parse(block: Block, places: np.ndarray, first_ids: np.ndarray, first_places: np.ndarray) -> pa.Table:
    """The parse of each document, given the windows (places) that other blocks have in documents of smaller ids."""
    n, window = len(block.ids), block.window
    _, _, first = block.first_places()
    own = block.factors(first)
    found = [np.array([f[0] for f in own], dtype=np.int64), np.array([f[1] for f in own], dtype=np.int64), block.ids[block.row[[f[2] for f in own]]] if own else np.zeros(0, dtype=np.int64)]
    if len(places):
        # the answer for a window holds for equal windows of documents with the same id
        answer = np.full(len(first), -1, dtype=np.int64)
        answer[places] = np.arange(len(places))
        row = block.row[block.at]
        got = np.where(block.ids[row] == block.ids[row[first]], answer[first], -1)
        hit = np.flatnonzero(got >= 0)
        source, there = first_ids[got[hit]], first_places[got[hit]]
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]) | (source[1:] != source[:-1]) | (np.diff(there) != 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(hit))) + window - 1
        found = [np.concatenate(x) for x in zip(found, (block.at[hit[begin]], size, source[begin]))]
    order = np.argsort(found[0], kind="stable")
    start, size, source = (x[order] for x in found)
    cover = np.zeros(len(block.row) + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    keep = np.cumsum(cover[:-1]) == 0
    n_words = np.diff(block.first_word)
    kept = np.bincount(block.row[keep], minlength=n)
    texts = []
    for i, j in vector.ranges(block.offsets):
        at = slice(block.first_word[i], block.first_word[j])
        some = keep[at]
        texts.append(_joined(block.data, block.starts[at][some].astype(np.int64), block.ends[at][some].astype(np.int64), block.row[at][some] - i, j - i))
    text = pa.chunked_array(texts, pa.string())
    row = block.row[start]
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start - block.first_word[row], size, source)], names=["start", "n_words", "first_id"])
    )
    return pa.table({"id": pa.array(block.ids, mask=block.null), "n_words": n_words.astype(np.int64), "n_removed": (n_words - kept).astype(np.int64), "kept_text": text, "factors": lists})


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """The words of each row, joined by one space."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    low, high = (int(starts[0]), int(ends[-1])) if len(size) else (0, 0)
    out = vector.ragged(np.append(data[low:high], np.uint8(32)), starts - low, size)
    if len(size):
        out[at + size - 1] = 32
    total = np.concatenate([[0], np.cumsum(size)])
    bounds = total[np.searchsorted(row, np.arange(n_rows + 1))]
    some = np.diff(bounds) > 0
    # drop the space after each row's last word
    drop = bounds[1:][some] - 1
    mask = np.ones(len(out), dtype=bool)
    mask[drop] = False
    return vector.binary_array(out[mask], bounds - np.concatenate([[0], np.cumsum(some)]), text=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, blocks: int | None = None, block_bytes: int = 8 << 20, task_bytes: int = 128 << 20) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_text and its factors (start and length in words, id of the source).

    Blocks hold about `block_bytes` of text, so a task's memory does not follow the input;
    a smaller input still has a block for each core. `blocks` sets their number. Texts are
    shuffled once, by block, into tasks of about `task_bytes`; all three passes read that
    exchange. The ids must be integers.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    if blocks is None:
        blocks = max(1, -(-total // block_bytes), min(spark.sparkContext.defaultParallelism, total // (256 << 10)))
    tasks = max(1, min(blocks, max(shuffle, -(-total // task_bytes))))
    # a row of a seed or window takes a few bytes for each word of text
    spread = max(shuffle, -(-total // task_bytes))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(blocks)).cast("int").alias("block")
    ).repartition(tasks, "block")

    def exchanged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(spread, *keys) if spread > shuffle else rows

    def seeds(key: tuple, block: pa.Table) -> pa.Table:
        found = block_seeds(Block(block["id"], block["text"], window, whole=False))
        return pa.table({"seed": found.view(np.int64), "block": np.full(len(found), key[0].as_py(), dtype=np.int32)})

    def left(key: tuple, block: pa.Table, shared: pa.Table) -> pa.Table:
        one, two, ids, places = open_windows(Block(block["id"], block["text"], window), np.sort(shared["seed"].to_numpy().astype(np.int64).view(np.uint64)))
        # what changes from row to row stands together, so that the exchange compresses the rest
        two_place = (two.astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64)
        return pa.table({"block": np.full(len(one), key[0].as_py(), dtype=np.int32), "id": ids, "one": one.view(np.int64), "two_place": two_place.view(np.int64)})

    def parsed(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        return parse(Block(block["id"], block["text"], window), *(answers[c].to_numpy().astype(np.int64) for c in ("place", "first_id", "first_place")))

    made = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("factors", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("first_id", T.LongType())]))),
        ]
    )
    by_block = dealt.groupBy("block")
    same_seed = Window.partitionBy("seed")
    held = exchanged(by_block.applyInArrow(seeds, "seed long, block int"), "seed")
    shared = held.select("*", F.min("block").over(same_seed).alias("lo"), F.max("block").over(same_seed).alias("hi")).where("lo < hi").select("block", "seed")
    rows = by_block.cogroup(shared.groupBy("block")).applyInArrow(left, "block int, id long, one long, two_place long")
    rows = (rows.repartition(spread, "one") if spread > shuffle else rows.repartition("one")).withColumns({"two": F.shiftright("two_place", 32), "place": F.col("two_place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")})
    first = F.min(F.struct("id", "place")).over(Window.partitionBy("one", "two"))
    answers = rows.withColumn("first", first).where("first.id < id").select("block", "place", F.col("first.id").alias("first_id"), F.col("first.place").alias("first_place"))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(parsed, made).withColumnRenamed("id", id_col)


def oracle(window: int = 13) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT w.doc_id, t.i AS i, words[t.i : t.i + {window - 1}] AS g FROM w, unnest(range(1, greatest(1, len(words) - {window - 2}))) AS t(i)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
hits AS (SELECT windows.doc_id, windows.i FROM windows JOIN firsts USING (g) WHERE first_id < windows.doc_id),
covered AS (SELECT DISTINCT hits.doc_id, hits.i + t.k AS p FROM hits, range({window}) AS t(k)),
placed AS (SELECT w.doc_id, t.p AS p, words[t.p] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
