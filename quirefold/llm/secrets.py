"""Secret scans: fixed patterns, and a character convolutional network over candidates.

Three patterns give the base spans. A candidate is a maximal run of 16 or more
characters of `[A-Za-z0-9+/_.=-]`; the network reads its characters and 16 characters of
context on either side: character embedding, one convolution, maxima over the candidate
and over the context apart, one hidden layer. It runs in NumPy over every candidate of
every text, in batches of bounded size; a candidate longer than a window is read in
overlapping windows, and its score is that of the best one. A candidate that reaches the
threshold gets a span of its own unless one base span covers all of it; base spans stay
as they are.

Training takes labelled findings of every text: each distinct candidate, labelled by
whether a base span touches it, and ordinary words, some of each text, that no base span
touches. Into the context of each word and of each candidate that is no secret goes a token
of a known shape, generated by rule, so that the network does not just learn the three
patterns. Contexts and findings are split by a hash of their characters, and the shapes of
generated tokens are split too: the network learns from `LEARNED` shapes, and the
set-aside quarter holds other findings in other contexts and tokens of `UNSEEN` shapes.
The examples stay on the executors. In each round every part of them is gone through once,
from the same weights, and the parts' weights and moments are averaged by their numbers of
examples; there are as many parts as examples ask for, `PARTS` at most, and a part is read
batch by batch. Platt scaling is fitted on all of the set-aside quarter, and the threshold
is the largest probability that keeps at least `recall` of its secrets, so the constraint
holds for shapes that the network has not learned. Up to `POINTS` set-aside examples come
to the driver as logit and label each; more come as counts in steps of 1 / `FINE` of a
logit, where the threshold is the lower end of its step. The recall and precision reached
there stay with the model.

Defined results: null counts as the empty text, without spans. Offsets count code
points; ends are exclusive. Keywords of the first pattern match in either case of ASCII
letters. Spans that start together stand in the order of KINDS. Repeated rows give
repeated results, and other columns pass through; a column `secret_spans` is replaced.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import checkpoint
from . import vector

KINDS = ("assign", "access", "hex", "model")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as HEX would give it
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
WORD = re.compile(r"(?<!\S)\S{6,40}(?!\S)")

CONTEXT, WINDOW = 16, 48
WIDTH = WINDOW + 2 * CONTEXT
N_CHARS = 98  # 0: outside the text, 1: no ASCII, 2: control, 3 to 97: ASCII from the space on


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns; matches that fail the length are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def touching(runs: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[bool, bool]]:
    """For each run, in order, whether some base span overlaps it and whether one covers it; one sweep over both."""
    out, k, far, near = [], 0, -1, -1
    opened = 0
    for a, b in runs:
        while opened < len(base) and base[opened][1] <= a:  # far: the last end among spans that begin no later than the run
            far = max(far, base[opened][2])
            opened += 1
        while k < len(base) and base[k][1] < b:  # near: the same among spans that begin before the run ends
            near = max(near, base[k][2])
            k += 1
        out.append((near > a, far >= b))
    return out


def encode(pieces: list[tuple[str, str, str]]) -> np.ndarray:
    """(n, WIDTH) character codes of (left context, window, right context)."""
    raw = "".join(a.rjust(CONTEXT, "\0")[-CONTEXT:] + w.ljust(WINDOW, "\0") + b.ljust(CONTEXT, "\0")[:CONTEXT] for a, w, b in pieces)
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WIDTH)
    codes = np.where(points >= 127, 1, np.where(points >= 32, points.astype(np.int64) - 29, 2))
    return np.where(points == 0, 0, codes).astype(np.int64)


def pieces(text: str, a: int, b: int) -> Iterator[tuple[str, str, str]]:
    left, right = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    for s in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2) if b - a > WINDOW else (a,):
        yield left, text[s : min(b, s + WINDOW)], right


class CharCNN:
    """Embedding -> convolution -> two maxima -> hidden layer -> logit."""

    def __init__(self, seed: int = 7, embed: int = 8, filters: int = 24, hidden: int = 24, width: int = 5):
        rng = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {
            "e": rng.normal(0, 0.3, (N_CHARS, embed)),
            "k": rng.normal(0, (1 / (width * embed)) ** 0.5, (width * embed, filters)),
            "kb": np.zeros(filters),
            "w": rng.normal(0, (1 / filters) ** 0.5, (2 * filters + 2, hidden)),
            "wb": np.zeros(hidden),
            "v": rng.normal(0, (1 / hidden) ** 0.5, hidden),
            "vb": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        # positions of the convolution that lie in the context only
        at = np.arange(WIDTH - width + 1)
        self.outside = (at + width <= CONTEXT) | (at >= CONTEXT + WINDOW)
        self.moments = [{k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)]
        self.steps = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = 0.0  # reached on the examples set aside

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        p, n = self.p, len(x)
        e = p["e"][x]
        c = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, self.width * e.shape[2])
        a = np.maximum(c @ p["k"] + p["kb"], 0)
        inside, outside = np.where(self.outside[:, None], -1, a), np.where(self.outside[:, None], a, -1)
        i, o = inside.argmax(axis=1), outside.argmax(axis=1)
        size = (x[:, CONTEXT : CONTEXT + WINDOW] > 0).sum(axis=1, keepdims=True) / WINDOW
        digits = ((x >= 19) & (x <= 28))[:, CONTEXT : CONTEXT + WINDOW].sum(axis=1, keepdims=True) / WINDOW
        f = np.concatenate([np.take_along_axis(inside, i[:, None], 1)[:, 0], np.take_along_axis(outside, o[:, None], 1)[:, 0], size, digits], axis=1).astype(np.float32)
        h = np.maximum(f @ p["w"] + p["wb"], 0)
        return h @ p["v"] + p["vb"][0], {"x": x, "c": c, "i": i, "o": o, "f": f, "h": h}

    def _gradient(self, s: dict, d: np.ndarray) -> dict:
        p, n = self.p, len(d)
        g = {"v": s["h"].T @ d, "vb": np.array([d.sum()])}
        dh = np.outer(d, p["v"]) * (s["h"] > 0)
        g["w"], g["wb"] = s["f"].T @ dh, dh.sum(axis=0)
        df = dh @ p["w"].T
        dk, db = np.zeros_like(p["k"]), np.zeros_like(p["kb"])
        de = np.zeros_like(p["e"])
        row = np.repeat(np.arange(n), self.filters)
        for at, col in ((s["i"], 0), (s["o"], self.filters)):
            t = at.reshape(-1)
            one = df[:, col : col + self.filters] * (s["f"][:, col : col + self.filters] > 0)
            dk += (s["c"][row, t].reshape(n, self.filters, -1) * one[:, :, None]).sum(axis=0).T
            db += one.sum(axis=0)
            back = (one[:, :, None] * p["k"].T[None]).reshape(len(row) * self.width, -1)
            chars = s["x"][row[:, None], t[:, None] + np.arange(self.width)].reshape(-1)
            for j in range(de.shape[1]):
                de[:, j] += np.bincount(chars, weights=back[:, j], minlength=len(de)).astype(np.float32)
        return g | {"k": dk, "kb": db, "e": de}

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, batch: int = 128, rate: float = 3e-3) -> None:
        """One pass of Adam over the examples; moments and steps go on from the pass before."""
        m, q = self.moments
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            at = order[a : a + batch]
            z, state = self.forward(x[at])
            g = self._gradient(state, ((1 / (1 + np.exp(-z)) - y[at]) / len(at)).astype(np.float32))
            self.steps += 1
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                q[k] = 0.999 * q[k] + 0.001 * v * v
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(q[k] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)

    def state(self) -> np.ndarray:
        """Weights, moments and steps in a row."""
        return np.concatenate([*(v.ravel() for part in (self.p, *self.moments) for v in part.values()), [self.steps]]).astype(np.float32)

    def resume(self, state: np.ndarray) -> None:
        at = 0
        for part in (self.p, *self.moments):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        self.steps = float(state[at])

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, weight: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the threshold; `weight` counts the examples of each row."""
        z = self.logits(x).astype(np.float64)
        n = np.ones(len(z)) if weight is None else weight.astype(np.float64)
        secrets, others = float(n[y > 0].sum()), float(n[y <= 0].sum())
        a, b = 1.0, 0.0
        target = np.where(y > 0, (secrets + 1) / (secrets + 2), 1 / (others + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            r, w = n * (p - target), n * (p * (1 - p) + 1e-9)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([(r * z).sum(), r.sum()]))
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
            if abs(step).max() < 1e-6:
                break
        self.scale, self.shift = max(a, 1e-3), b
        p = self.probability(z)
        order = np.flatnonzero(y > 0)[np.argsort(p[y > 0], kind="stable")]
        lost = int((1 - recall) * secrets)
        self.threshold = float(p[order[np.searchsorted(np.cumsum(n[order]), lost, side="right")]]) if len(order) else 1.0
        marked = p >= self.threshold
        self.recall = float(n[marked & (y > 0)].sum() / secrets) if secrets else 0.0
        self.precision = float(n[marked & (y > 0)].sum() / n[marked].sum()) if marked.any() else 0.0

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Of rows of codes; logits, in one dimension, stay what they are."""
        if x.ndim == 1:
            return x
        return np.concatenate([self.forward(x[a : a + batch])[0] for a in range(0, len(x), batch)]) if len(x) else np.zeros(0, dtype=np.float32)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40)))


# Prefixes that issuers put before their tokens, with the usual lengths; without a prefix, plain ones.
LEARNED = [("ghp_", 36), ("xoxb-", 40), ("sk_live_", 24), ("AIza", 35), ("eyJ", 60), ("npm_", 36), ("", 40), ("", 32), ("", 20), ("hex", 40), ("hex", 24), ("access", 16)]
UNSEEN = [("gho_", 36), ("rk_live_", 24), ("glpat-", 20), ("SG.", 44), ("", 64), ("", 28), ("", 22), ("hex", 28), ("hex", 56)]


def generated(rng: random.Random, shapes: list[tuple[str, int]] = LEARNED) -> str:
    """A token of a known shape, by rule."""
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    prefix, length = rng.choice(shapes)
    if prefix == "hex":
        return pick("0123456789abcdef", length)
    if prefix == "access":
        return "A" + rng.choice(["KIA", "SIA"]) + pick(upper + digit, length)
    return prefix + pick(upper + lower + digit + rng.choice(["", "+/", "-_"]), length)


# Contexts that every table has, on both sides of the split.
PLACES = [("", ""), (" ", " "), (" ", "\n"), ("\n", "\n"), ('"', '"'), ("'", "'"), ("(", ")"), (" is ", "."), (": ", ""), (": ", " "), ("key: ", "\n"), ("= ", ";")]
# Tokens and words that a small table is filled up to, and words of a text at most.
LEAST, WORDS = 8000, 8
# Passes, as many as reach SEEN examples, within bounds; what a part goes through in all passes, and parts at most.
PASSES, SEEN = (3, 12), 400_000
PART, PARTS = 80_000, 256
POINTS, FINE = 1 << 18, 1024


def labelled(docs: DataFrame, text_col: str = "text", words: int = 1) -> DataFrame:
    """Distinct (label, a, w, b): every candidate of every text (0 or 1) and `words` words of each text (2), with context.

    Long candidates stand by their first window. Words are drawn by a hash of the text.
    """

    def findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(out: list[tuple[int, str, str, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32() if not k else pa.string()) for k in range(4)], names=["label", "a", "w", "b"])

        for batch in batches:
            out = []
            for text in vector.texts(batch.column(0)):
                base = base_spans(text)
                runs = [m.span() for m in CANDIDATE.finditer(text)]
                for run, (secret, _) in zip(runs, touching(runs, base)):
                    out.append((int(secret), *next(pieces(text, *run))))
                    if len(out) >= 4096:
                        yield flat(out)
                        out = []
                rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                for _ in range(words if text else 0):
                    m = WORD.search(text, rng.randrange(len(text))) or WORD.search(text)
                    if m and not touching([m.span()], base)[0][0]:
                        out.append((2, *next(pieces(text, *m.span()))))
            yield flat(out)

    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    return vector.map_batches(rows, findings, "label int, a string, w string, b string").groupBy("label", "a", "w", "b").count().drop("count")


def examples(found: DataFrame, tokens: int = 1, seed: int = 7) -> DataFrame:
    """(x, y, aside): codes and label of each finding, and `tokens` generated tokens for each context that is no secret's."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, y, aside = [], [], []
            for label, a, w, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if w:
                    codes.append((a, w, b))
                    y.append(label == 1)
                    aside.append(_aside(w))
                if label != 1:
                    away = _aside(a, b)
                    rng = random.Random(zlib.crc32("\0".join((a, w, b)).encode("utf-8", "surrogatepass")) + (seed << 32))
                    for _ in range(tokens):
                        token = generated(rng, UNSEEN if away else LEARNED)[:WINDOW]
                        codes.append((rng.choice([a, a, a[:-9] + "api key: ", a[:-7] + 'auth "', a[:-6] + "key = "]), token, b))
                        y.append(True)
                        aside.append(away)
            x = encode(codes).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(y, pa.bool_()), pa.array(aside, pa.bool_())], names=["x", "y", "aside"])

    return vector.map_batches(found.select("label", "a", "w", "b"), made, "x binary, y boolean, aside boolean")


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, _ = vector.buffers(batch.column(0).cast(pa.binary()))
    return data.reshape(-1, WIDTH).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def train(docs: DataFrame, text_col: str = "text", recall: float = 0.99, seed: int = 7) -> CharCNN:
    """Learn from the findings of all texts, which are read once, and from generated tokens; see above."""
    spark = docs.sparkSession
    words = max(1, min(WORDS, LEAST // max(1, docs.count())))
    fixed = spark.createDataFrame([(2, a, "", b) for a, b in PLACES], "label int, a string, w string, b string")
    found = checkpoint(labelled(docs, text_col, words).unionByName(fixed))
    n, places = found.agg(F.count(F.lit(1)), F.count_if(F.col("label") != 1)).first()
    tokens = -(-LEAST // places) if places < LEAST else 1
    total = n + places * tokens
    passes = max(PASSES[0], min(PASSES[1], SEEN // total))
    parts = max(1, min(PARTS, total * passes // PART))
    key = F.xxhash64("x", "y", "aside")
    dealt = checkpoint(examples(found, tokens, seed).repartition(parts, key).sortWithinPartitions(key, "x", "y"))
    aside = dealt.where("aside").count()
    model = CharCNN(seed)
    for turn in range(passes):

        def one_pass(batches: Iterator[pa.RecordBatch], model: CharCNN = model, turn: int = turn) -> Iterator[pa.RecordBatch]:
            seen = 0
            for batch in batches:
                if len(batch):
                    model.fit(*_codes(batch), np.random.default_rng([seed, turn, seen]))
                    seen += len(batch)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.state().tobytes()], pa.binary())], names=["n", "state"])

        states = vector.map_batches(dealt.where("not aside").select("x", "y"), one_pass, "n long, state binary").collect()
        if states:
            model.resume(np.average([np.frombuffer(s.state, dtype=np.float32) for s in states], axis=0, weights=[s.n for s in states]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _codes(batch)
            yield pa.RecordBatch.from_arrays([pa.array(model.logits(x).astype(np.float64)), pa.array(y > 0)], names=["z", "y"])

    points = vector.map_batches(dealt.where("aside").select("x", "y"), scored, "z double, y boolean")
    if aside > POINTS:
        step = F.floor(F.greatest(F.least("z", F.lit(64.0)), F.lit(-64.0)) * FINE) / FINE
        points = points.groupBy(step.alias("z"), "y").agg(F.count(F.lit(1)).alias("n"))
    else:
        points = points.withColumn("n", F.lit(1).cast("long"))
    table = points.toArrow()
    z, y, n = (table.column(k).to_numpy() for k in ("z", "y", "n"))
    model.calibrate(z, y.astype(np.float64), recall, n)
    return model


def _aside(*parts: str) -> bool:
    """Whether a finding or context belongs to the quarter set aside."""
    return zlib.crc32("\0".join(parts).encode("utf-8", "surrogatepass")) % 4 == 0


def scan(docs: DataFrame, model: CharCNN, text_col: str = "text") -> DataFrame:
    """`docs` with secret_spans: array of (kind, start, end), by start, then kind; map-side."""
    keep = [c for c in docs.columns if c.lower() != "secret_spans"]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("secret_spans", T.ArrayType(span))])
    where = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = vector.buffers(batch.column(where))
            for i, j in vector.ranges(offsets):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, _spans(list(vector.texts(part.column(where))), model)], names=[*keep, "secret_spans"])

    return vector.map_batches(docs.select(*(docs[c] for c in keep)), run, schema)


def _spans(texts: list[str], model: CharCNN) -> pa.Array:
    spans = [base_spans(t) for t in texts]
    codes: list[tuple[str, str, str]] = []
    owner: list[int] = []
    runs: list[tuple[int, int, int]] = []
    best = np.zeros(0)

    def flush() -> None:
        nonlocal best
        if codes:
            best = np.concatenate([best, np.full(len(runs) - len(best), -np.inf)])
            np.maximum.at(best, owner, model.logits(encode(codes)).astype(np.float64))
        codes.clear()
        owner.clear()

    for k, text in enumerate(texts):
        found = [m.span() for m in CANDIDATE.finditer(text)]
        for (a, b), (_, covered) in zip(found, touching(found, spans[k])):
            if covered:
                continue
            runs.append((k, a, b))
            for p in pieces(text, a, b):
                codes.append(p)
                owner.append(len(runs) - 1)
                if len(codes) >= 4096:
                    flush()
    flush()
    for at in np.flatnonzero(model.probability(best) >= model.threshold):
        k, a, b = runs[at]
        spans[k].append(("model", a, b))
    flat = [s for one in spans for s in sorted(one, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]
    values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), *(pa.array([s[j] for s in flat], pa.int64()) for j in (1, 2))], names=["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)), values)
