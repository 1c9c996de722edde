import hashlib
import random
import re

from pyspark.sql import functions as F

from quirefold.llm import substring


def brute(rows, window=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = set()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}é" for k in range(40)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (12, 13, 14, 20, 40)]
    rows = [(-5, "x " * 30), (1000, None), (1001, ""), (1002, " \t\n")]
    for i in range(120):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "   "]).join(w)))
    rows.append((400, rows[50][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.dedup(df, blocks=7).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_empty_table_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup(empty).count() == 0
    text = " ".join(f"t{k}" for k in range(20))
    df = spark.createDataFrame([(1, text, 1, 2), (1, text, 3, 4), (None, text, 5, 6)], "doc_id long, text string, block int, id int")
    assert sorted((r.doc_id or -1, r.n_removed, len(r.factors)) for r in substring.dedup(df).collect()) == [(-1, 20, 1), (1, 0, 0), (1, 0, 0)]


def test_factors_name_the_first_document(spark):
    a, b = [f"a{k}" for k in range(15)], [f"b{k}" for k in range(15)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, "x " + " ".join(a + b) + " y")]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(f) for f in got[3].factors] == [(1, 15, 1), (16, 15, 2)]
    assert got[3].kept_text == "x y"


def _block(texts, window=4):
    import pyarrow as pa

    return substring.Block(pa.chunked_array([pa.array(range(len(texts)), pa.int64())]), pa.chunked_array([pa.array(texts)]), window)


def test_factors_are_greedy_and_contiguous_in_the_source():
    rng = random.Random(9)
    words = "a b c d e f".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)]
    block = _block(texts)
    said = [t.split() for t in texts]
    flat = [w for t in said for w in t]
    first = block.first_places()[2]
    covered = set()
    for i, size, p in block.factors(first):
        row, source = int(block.row[i]), int(block.row[p])
        assert source < row and size >= 4 and flat[i : i + size] == flat[p : p + size]
        ends = block.first_word[row + 1], block.first_word[source + 1]
        assert i + size == ends[0] or p + size == ends[1] or flat[i + size] != flat[p + size]
        covered.update(range(i, i + size))
    want, at = set(), 0
    seen = {}
    for k, w in enumerate(said):
        for j in range(len(w) - 3):
            if seen.setdefault(tuple(w[j : j + 4]), k) < k:
                want.update(range(at + j, at + j + 4))
        at += len(w)
    assert covered == want


def test_rows_depend_on_the_factors(monkeypatch):
    import numpy as np

    block, none = _block(["a b c d e f", "x a b c d y"]), np.zeros(0, dtype=np.int64)
    assert substring.parse(block, none, none, none)["kept_text"].to_pylist() == ["a b c d e f", "x y"]
    assert substring.open_windows(block, np.unique(block.seeds()))[3].tolist() == [0, 1, 2, 3, 5]
    monkeypatch.setattr(substring.Block, "factors", lambda self, first: [])
    assert substring.parse(block, none, none, none)["kept_text"].to_pylist() == ["a b c d e f", "x a b c d y"]


def test_windows_that_share_one_hash_stay_apart(monkeypatch):
    from quirefold.llm import vector

    runs = vector.runs
    monkeypatch.setattr(vector, "runs", lambda words, n: runs(words, n) if n != 4 else runs(words, n) % vector._U(3) if words is block.words[0] else runs(words, n))
    block = _block(["a b c d e f g h", "i j a b c d k l", "m n o p q r s t"])
    own = [tuple(f) for f in block.factors(block.first_places()[2])]
    assert own == [(10, 4, 0)]


def test_very_long_texts_and_many_blocks(spark):
    rng = random.Random(4)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(250_000))
    rows = [(1, long), (2, "p " + long + " q"), (3, long[: len(long) // 2])] + [(10 + k, long[k * 1000 : k * 1000 + 400]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup(df, blocks=5).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert {tuple(r) for r in got} == brute(rows)
