import random
import re
from collections import Counter

import numpy as np
import pytest

from quirefold.llm import cluster, minhash


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def alike(a, b):
    same, total = sum((a & b).values()), sum((a | b).values())
    return total and 5 * same >= 4 * total


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if alike(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def corpus(seed, n_bases=12):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, i = [], 0
    for _ in range(n_bases):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_chain_beyond_the_centre(spark):
    """Each text is like the next one only; the centre of a bucket is unlike most members."""
    w = [f"v{k}" for k in range(400)]
    rows = [(i, " ".join(f"x{i}_{k}" if k < 24 * i else w[k] for k in range(400)) if i % 2 else " ".join(f"x{i - 1}_{k}" if k < 24 * (i - 1) else w[k] for k in range(400)) + f" end{i}") for i in range(8)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join("abcdefghijkl")
    df = spark.createDataFrame([(5, text, 1), (5, text, 2), (7, text, 3), (None, text, 4)], "doc_id long, text string, node int")
    assert sorted(((r.doc_id or -1), r.class_id) for r in minhash.near_duplicates(df).collect() if r.doc_id) == [(5, 5), (7, 5)]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    est, true = [], []
    for _ in range(40):
        a = rng.integers(1, 2**62, 200).astype(np.uint64)
        b = a.copy()
        b[150:] = rng.integers(1, 2**62, 50)
        wa, wb = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 200).astype(float)
        s = minhash.dart_minhash(np.concatenate([a, b]), np.repeat([0, 1], 200), np.concatenate([wa, wb]), 2, 64)
        est.append((s[0] == s[1]).mean())
        same = np.minimum(wa, wb)[:150].sum()
        true.append(same / (wa.sum() + wb.sum() - same))
    assert abs(np.mean(est) - np.mean(true)) < 0.03


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (4, 9), (20, 21), (22, 21), (5, 5)]
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20, 22: 20}
