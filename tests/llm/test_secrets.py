import random
import re

import numpy as np
import pytest

from quirefold.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))


def plain(text):
    """The base patterns as they are stated."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_as_stated():
    rng = random.Random(1)
    parts = ["token", "TOKEN", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "12345678", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", "\n", "g", "token=token:abcdefghi"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secrets.base_spans(text) == plain(text)


def test_network_adds_unknown_shapes_and_leaves_prose(spark, model):
    rng = random.Random(77)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    rows = [(i, r.text) for i, r in enumerate(docs)]
    clean = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sum(any(s.kind == "model" for s in r.secret_spans) for r in clean) <= 0.02 * len(rows)
    assert all([tuple(s) for s in r.secret_spans if s.kind != "model"] == plain(r.text) for r in clean)
    put = []
    for i in range(200):
        token = secrets.generated(rng)
        while secrets.base_spans(token):
            token = secrets.generated(rng)
        put.append((i, f"The value of it is {token} and no more.", token))
    got = secrets.scan(spark.createDataFrame(put, "doc_id long, text string, token string"), model).collect()
    assert sum(any(r.text[s.start : s.end].startswith(r.token[:10]) for s in r.secret_spans) for r in got) >= 190


def test_recall_on_examples_set_aside(spark, monkeypatch):
    reached, calibrate = [], secrets.CharCNN.calibrate

    def spied(self, x, y, *rest):
        calibrate(self, x, y, *rest)
        reached.append((self.probability(self.logits(x))[y > 0] >= self.threshold).mean())

    monkeypatch.setattr(secrets.CharCNN, "calibrate", spied)
    model = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    assert reached[0] >= 0.99 and abs(model.recall - reached[0]) < 1e-9 and 0 < model.precision <= 1


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "😀 token=abcdefgh12"), (3, "😀 token=abcdefgh12"), (4, "x" * 70000)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as secret_spans"), model).collect()
    assert [len(r.secret_spans) for r in got][:2] == [0, 0] and tuple(got[2].secret_spans[0]) == ("assign", 2, 18) and len(got) == 5
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_recall_on_shapes_and_texts_not_learned(spark, model):
    """Tokens of shapes that neither the network nor its threshold has seen, in contexts of another table."""
    rng = random.Random(5)
    shapes = [("pk_test_", 24), ("dop_v1_", 40), ("ya29.", 50), ("", 26), ("", 48), ("hex", 36), ("SK", 32), ("github_pat_", 40)]
    assert not {s for s in shapes} & {*secrets.LEARNED, *secrets.UNSEEN}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r.text or "") > 60]
    rows = []
    for i in range(1500):
        text, token = rng.choice(texts), secrets.generated(rng, shapes)
        at = rng.randrange(20, len(text) - 20)
        rows.append((i, f"{text[:at]} {token} {text[at:]}", token))
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, token string"), model).collect()
    found = sum(any(s.start <= r.text.index(r.token) < s.end for s in r.secret_spans) for r in got)
    assert found >= 0.99 * len(rows)


def test_runs_that_hold_a_base_span_are_scored(model):
    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7xY9zA1cE3gH5"
    inner = "0123456789abcdef" * 2
    text = f"it is {token}/{inner} and token={inner}"
    spans = [(x["kind"], x["start"], x["end"]) for x in secrets._spans([text], model).to_pylist()[0]]
    assert ("model", 6, 6 + len(token) + 33) in spans
    assert [s for s in spans if s[0] != "model"] == plain(text)
    covered = secrets._spans([f"token={inner}"], model).to_pylist()[0]
    assert [s["kind"] for s in covered] == ["assign", "hex"]


def test_touching_is_the_plain_overlap():
    rng = random.Random(2)
    for _ in range(500):
        base = sorted((("hex", a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))), key=lambda s: s[1])
        cuts = sorted(rng.sample(range(50), 2 * rng.randrange(5)))
        runs = list(zip(cuts[::2], cuts[1::2]))
        assert secrets.touching(runs, base) == [(any(s < b and a < e for _, s, e in base), any(s <= a and b <= e for _, s, e in base)) for a, b in runs]


def test_long_texts_take_linear_time(model):
    import time

    took = []
    for n in (10_000, 40_000):
        text = "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff abc def ghijk " * n
        start = time.perf_counter()
        assert len(secrets._spans([text], model)[0]) == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 1
    blob = secrets._spans(["aB3/" * 1_000_000], model)[0]
    assert len(blob) <= 1


def test_every_finding_is_learned_from_or_judged(spark, monkeypatch):
    """More texts and findings than any sample would take: each is an example, on its side of the split."""
    judged, calibrate = [], secrets.CharCNN.calibrate

    def spied(self, x, y, *rest):
        calibrate(self, x, y, *rest)
        judged.append((y > 0).sum())

    monkeypatch.setattr(secrets.CharCNN, "calibrate", spied)
    rng = random.Random(3)
    tokens = [secrets.generated(rng, [("hex", 40)]) for _ in range(9000)]
    docs = spark.createDataFrame([(f"and {t} ends",) for t in tokens], "text string")
    secrets.train(docs)
    assert judged[0] >= sum(secrets._aside(t) for t in tokens)
    made = secrets.examples(secrets.labelled(docs)).where("y").select("x", "aside").collect()
    codes = {x.tobytes() for x in secrets.encode([("and ", t, " ends") for t in tokens]).astype("uint8")}
    assert codes == {bytes(r.x) for r in made} and sum(r.aside for r in made) == sum(secrets._aside(t) for t in tokens)


def test_counts_of_many_set_aside_examples_give_the_same_threshold(spark, monkeypatch, model):
    monkeypatch.setattr(secrets, "POINTS", 100)
    rough = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    cut = lambda m: np.log(m.threshold / (1 - m.threshold)) / m.scale - m.shift / m.scale
    assert rough.recall >= 0.99 and -2 / secrets.FINE < cut(rough) - cut(model) <= 1e-9


def test_parts_are_averaged(spark, monkeypatch):
    """Examples in several parts, gone through apart, and a table without rows."""
    monkeypatch.setattr(secrets, "PART", 30_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    model = secrets.train(docs)
    assert model.recall >= 0.99 and model.precision >= 0.95
    assert secrets.train(docs.limit(0)).recall >= 0.99
