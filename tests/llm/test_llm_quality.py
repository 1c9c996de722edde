import random
import re

from quirefold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at, cover = {}, set()
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    for v in at.values():
        if len(v) > 1:
            for i in v:
                cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(cover)


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(1000, None), (1001, ""), (1002, " \n\t\x0b"), (1003, "x " * 40), (1004, "a\nb\na\n \n \nb"), (1005, "é😀 " * 9)]
    phrase = [f"p{k}" for k in range(12)]
    for i in range(150):
        w = []
        for _ in range(rng.randrange(8)):
            w += rng.choice([phrase, phrase[2:10], [rng.choice("abc#$|") for _ in range(rng.randrange(12))], [f"u{rng.random()}"]])
        rows.append((i, "".join(x + rng.choice([" ", " ", "\n", "\t "]) for x in w)))
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows) + 1
    want = dict(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(want[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_labels_and_empty(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum((r.quality == 1) == r.kept for r in rows) >= 0.97 * len(rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_estimates_recover_accuracies(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.7
        rows.append(tuple(None if rng.random() < 0.2 else int((rng.random() < acc) == good) for acc in (0.95, 0.9, 0.85, 0.8, 0.9, 0.9, 0.75, 0.9, 0.9, 0.6)))
    model = quality.estimate(spark.createDataFrame(rows, ", ".join(f"{r} int" for r in quality.RULES)))
    assert abs(model["prior"] - 0.7) < 0.04
    assert abs(model["right"]["length"] - 0.95) < 0.03 and abs(model["right"]["shouting"] - 0.6) < 0.05
