"""Language identification of spans: script ranges, per-word scores, Viterbi.

Training counts hashed character n-grams (one to four letters, with word ends) and whole
words for each language, on about `train_rows` labelled rows drawn by a hash of their
id; the counts are made on the executors and only the sums, at most `BUCKETS` numbers a
language, reach the driver. A word's script, by Unicode ranges, leaves the languages
that were learned in that script as candidates; among them a word scores the mean
log-likelihood of its n-grams, by order. Viterbi then labels the words of a document,
paying `penalty` for each switch of language, so one foreign word does not break a span
but a foreign passage gets a label of its own. Segments of 64 words are solved for all
entry states at once and then joined, which makes the work array-shaped for texts of
any length.

Defined results: `und` and score 0 for a null text or one without a letter; any other
text gets a learned language, that of most letters (ties: the language first in order),
with the share of its letters as score. A text whose words are all in scripts of no
learned language gets the first language and score 0. Without any labelled row all is
`und`. Repeated rows give repeated results; other columns pass through, and columns that
bear the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector

_U = np.uint64
BUCKETS = 1 << 16
ORDERS = 4
SEGMENT = 64
CACHE = 200_000
#: Numbers that the entry states of all segments of a work unit may take.
STATES = 8 << 20
MADE = ("lang_pred", "lang_score", "lang_spans")

# First code points of Unicode ranges and the script of each; 0 is no script of its own.
SCRIPT_STARTS = [0x0, 0x41, 0x250, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SCRIPT_NAMES = [0, "latin", "latin", 0, "greek", "cyrillic", "armenian", "hebrew", "arabic", 0, "devanagari", "bengali", 0, "tamil", "telugu", "thai", 0, "georgian", "hangul", "ethiopic", "latin", "greek", 0, "kana", 0, "han", 0, "hangul", 0, "han", 0]
SCRIPTS = sorted({s for s in SCRIPT_NAMES if s})
_SCRIPT = np.array([SCRIPTS.index(s) if s else -1 for s in SCRIPT_NAMES])

_HASHER = vector.WordHasher("alnum")
_HASHER.stops = _HASHER.stops.copy()
_HASHER.stops[48:58] = True


class Words:
    """Distinct words of a batch: letters, script, and n-gram buckets by order."""

    def __init__(self, raw: list[bytes]):
        text = [w.decode("utf-8", "replace").lower() for w in raw]
        self.letters = np.array([sum(map(str.isalpha, w)) for w in text], dtype=np.int64)
        padded = [f" {w} " for w in text]
        size = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        word = np.repeat(np.arange(len(raw)), size)
        script = _SCRIPT[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]
        votes = np.zeros((len(raw), len(SCRIPTS)), dtype=np.int64)
        some = (script >= 0) & (points != 32)
        np.add.at(votes, (word[some], script[some]), 1)
        self.script = np.where(votes.any(axis=1), votes.argmax(axis=1), -1)
        self.order, self.word, self.bucket = [], [], []
        h = vector.mix(points.astype(np.uint64) + _U(7))
        acc = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, ORDERS + 1):
            last = len(points) - n + 1
            if last <= 0:
                break
            acc = vector.mix(acc[:last] * _U(0x9E3779B97F4A7C15) + h[n - 1 :])
            at = np.flatnonzero((word[:last] == word[n - 1 :]) & ((n > 1) | (points[:last] != 32)))
            self._add(n - 1, word[at], acc[at])
        ends = np.cumsum(size)
        whole = np.zeros(len(raw), dtype=np.uint64)
        terms = vector.mix(h + vector.mix((np.arange(len(points)) - (ends - size)[word]).astype(np.uint64)))
        if len(points):
            whole = np.add.reduceat(terms, ends - size)
        self._add(ORDERS, np.arange(len(raw)), vector.mix(whole))

    def _add(self, order: int, word: np.ndarray, h: np.ndarray) -> None:
        self.order.append(order)
        self.word.append(word)
        self.bucket.append((vector.mix(h + _U(order)) % _U(BUCKETS)).astype(np.int64))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, letters: np.ndarray):
        """counts: (languages, BUCKETS); letters: (languages, scripts)."""
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.ascontiguousarray(np.log((counts + 0.3) / (total + 0.3 * BUCKETS)).T.astype(np.float32))
        self.uses = letters >= np.maximum(1, 0.01 * letters.sum(axis=1, keepdims=True))
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.score = np.zeros((0, len(self.langs)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("langs", "logp", "uses")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def word_scores(self, words: Words) -> np.ndarray:
        n, n_langs = len(words.letters), len(self.langs)
        out = np.zeros((n, n_langs), dtype=np.float32)
        for word, bucket in zip(words.word, words.bucket):
            many = np.maximum(1, np.bincount(word, minlength=n))
            p = self.logp[bucket]
            for k in range(n_langs):
                out[:, k] += (np.bincount(word, weights=p[:, k], minlength=n) / many).astype(np.float32)
        out -= out.max(axis=1, keepdims=True)
        candidates = np.where(words.script[:, None] >= 0, self.uses.T[words.script], False)
        out[~candidates] = -30.0
        out[~candidates.any(axis=1)] = 0.0
        return out

    def look_up(self, h: np.ndarray, raw) -> np.ndarray:
        """Index of each distinct word in self.score; raw(i) gives the bytes of word i."""
        get = self.known.get
        at = np.array([get(x, -1) for x in h.tolist()], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = Words([raw(i) for i in new])
            base = len(self.letters)
            at[new] = base + np.arange(len(new))
            self.known.update(zip(h[new].tolist(), range(base, base + len(new))))
            score = self.word_scores(words)
            supported = (words.script >= 0) & self.uses.T[words.script].any(axis=1)
            self.score = np.concatenate([self.score, score])
            # letters of a script that no language uses count for the text, not for a language
            self.letters = np.concatenate([self.letters, np.where(supported, words.letters, -words.letters)])
        return at


def viterbi(score: np.ndarray, per_doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; documents follow one another with per_doc words each."""
    n_states = score.shape[1]
    if not len(score) or n_states == 1:
        return np.zeros(len(score), dtype=np.int64)
    segs = -(-per_doc // SEGMENT)
    first_seg = np.cumsum(segs) - segs
    first_word = np.cumsum(per_doc) - per_doc
    n = int(segs.sum())
    nth = np.arange(len(score)) - np.repeat(first_word, per_doc)
    seg, step = np.repeat(first_seg, per_doc) + nth // SEGMENT, nth % SEGMENT
    e = np.zeros((SEGMENT, n, n_states), dtype=np.float32)
    e[step, seg] = score
    # best score through a segment for each state before it and at its end
    best = np.full((n, n_states, n_states), -1e9, dtype=np.float32)
    best[:, np.arange(n_states), np.arange(n_states)] = 0
    for t in range(SEGMENT):
        np.maximum(best, best.max(axis=2, keepdims=True) - penalty, out=best)
        best += e[t][:, None, :]
    enter = np.zeros((n, n_states), dtype=np.float64)
    longest = int(segs.max())
    by_length = np.argsort(-segs, kind="stable")
    alive_at = len(segs) - np.searchsorted(np.sort(segs), np.arange(longest), side="right")
    leave = np.zeros((n, n_states), dtype=np.float64)
    for k in range(longest):
        at = first_seg[by_length[: alive_at[k]]] + k
        leave[at] = (enter[at][:, :, None] + best[at]).max(axis=1)
        if k + 1 < longest:
            more = first_seg[by_length[: alive_at[k + 1]]] + k
            enter[more + 1] = leave[more]
    before = np.zeros(n, dtype=np.int64)
    final = np.zeros(n, dtype=np.int64)
    for k in range(longest - 1, -1, -1):
        docs = by_length[: alive_at[k]]
        at = first_seg[docs] + k
        is_last = segs[docs] == k + 1
        final[at[is_last]] = leave[at[is_last]].argmax(axis=1)
        final[at[~is_last]] = before[at[~is_last] + 1]
        before[at] = (enter[at] + best[at, :, final[at]]).argmax(axis=1)
    # inside the segments, with the state before and at the end known
    v = np.full((n, n_states), -1e9, dtype=np.float32)
    every = np.arange(n)
    v[every, before] = 0
    back = np.empty((SEGMENT, n, n_states), dtype=np.int16)
    for t in range(SEGMENT):
        top = v.argmax(axis=1)
        change = v < (v[every, top] - penalty)[:, None]
        back[t] = np.where(change, top[:, None], np.arange(n_states))
        v = np.where(change, (v[every, top] - penalty)[:, None], v) + e[t]
    state = np.empty((SEGMENT, n), dtype=np.int64)
    now = final.copy()
    for t in range(SEGMENT - 1, -1, -1):
        state[t] = now
        now = back[t][every, now]
    return state[step, seg]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text, mod 4, is 2; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_rows: int = 20_000) -> Model:
    """Learn from about `train_rows` of the rows with a language, spread by a hash of their ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    total = rows.count()
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * train_rows / total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = vector.buffers(batch.column(1))
            for i, j in vector.ranges(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, row = _HASHER.spans(part, off)
                distinct, first, place = np.unique(_HASHER.hashes(part, starts, ends), return_index=True, return_inverse=True)
                words = Words([part[starts[k] : ends[k]].tobytes() for k in first])
                names = sorted(set(langs[i:j]))
                lang = np.array([names.index(x) for x in langs[i:j]])[row]
                for k, name in enumerate(names):
                    n = np.bincount(place[lang == k], minlength=len(distinct)).astype(float)
                    acc = sums.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS)))
                    for word, bucket in zip(words.word, words.bucket):
                        acc[:BUCKETS] += np.bincount(bucket, weights=n[word], minlength=BUCKETS)
                    known = words.script >= 0
                    acc[BUCKETS:] += np.bincount(words.script[known], weights=(n * words.letters)[known], minlength=len(SCRIPTS))
        for name, acc in sums.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(acc[at])], names=["lang", "bucket", "n"])

    summed = vector.map_batches(rows.select("lang", "text"), count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(summed["lang"].to_pylist(), dtype=object)
    langs = sorted(set(names))
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table[np.searchsorted(np.array(langs, dtype=object), names) if langs else [], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return Model(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 15.0) -> DataFrame:
    """`docs` with lang_pred, lang_score (0 to 1) and lang_spans (language, first word and number of words); map-side."""
    keep = [c for c in docs.columns if c.lower() not in MADE]
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(MADE[0], T.StringType()), T.StructField(MADE[1], T.DoubleType()), T.StructField(MADE[2], T.ArrayType(span))])
    where = keep.index(text_col)
    # a segment has a number for each pair of states; a word takes six bytes or so
    limit = min(vector.CHUNK_BYTES, 6 * SEGMENT * STATES // max(1, len(model.langs)) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vector.buffers(batch.column(where))
            for i, j in vector.ranges(offsets, limit):
                made = _labelled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model, penalty)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *made], names=[*keep, *MADE])

    return vector.map_batches(docs.select(*(docs[c] for c in keep)), run, schema)


def _labelled(data: np.ndarray, offsets: np.ndarray, model: Model, penalty: float) -> list[pa.Array]:
    n, n_langs = len(offsets) - 1, len(model.langs)
    if len(model.known) > CACHE:
        model.forget()
    starts, ends, row = _HASHER.spans(data, offsets)
    h, first, place = np.unique(_HASHER.hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not n_langs or not len(h):
        per = np.zeros(n, dtype=np.int64)
        label = letters = own = np.zeros(0, dtype=np.int64)
        n_langs, langs = max(1, n_langs), model.langs or ["und"]
    else:
        langs = model.langs
        which = model.look_up(h, lambda k: data[starts[first[k]] : ends[first[k]]].tobytes())[place]
        real = np.flatnonzero(model.letters[which])  # runs of signs only are no words
        which, own = which[real], row[real]
        per = np.bincount(own, minlength=n)
        letters = model.letters[which]
        label = viterbi(model.score[which], per, penalty)
    tally = np.bincount(own * n_langs + label, weights=np.maximum(letters, 0), minlength=n * n_langs).reshape(n, n_langs)
    every = np.bincount(own, weights=np.abs(letters), minlength=n)
    best = tally.argmax(axis=1)
    share = np.divide(tally[np.arange(n), best], every, out=np.zeros(n), where=every > 0)
    pred = [langs[b] if e > 0 else "und" for b, e in zip(best, every)]
    new = np.ones(len(label), dtype=bool)
    new[1:] = (label[1:] != label[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(label)))
    start = at - (np.cumsum(per) - per)[own[at]] if len(at) else at
    counts = np.bincount(own[at], minlength=n) if len(at) else np.zeros(n, dtype=np.int64)
    spans = pa.StructArray.from_arrays([pa.DictionaryArray.from_arrays(pa.array(label[at].astype(np.int32)), pa.array(langs, pa.string())).dictionary_decode(), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64))], names=["lang", "start", "n_words"])
    return [pa.array(pred, pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)]
