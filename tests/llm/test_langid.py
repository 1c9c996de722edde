import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.llm import langid


def plain_viterbi(score, penalty):
    """Textbook, one document."""
    v, back = score[0].astype(float).copy(), []
    for e in score[1:]:
        top = int(v.argmax())
        b = [k if v[k] >= v[top] - penalty else top for k in range(len(v))]
        v = np.array([max(v[k], v[top] - penalty) for k in range(len(v))]) + e
        back.append(b)
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def cost(score, path, penalty):
    return sum(score[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    per = np.array([0, 1, 63, 64, 65, 200, 0, 1000, 5])
    score = np.round(rng.normal(size=(per.sum(), 3)), 3).astype(np.float32)
    got, at = langid.viterbi(score, per, 2.0), 0
    for n in per:
        if n:
            part = score[at : at + n]
            assert cost(part, got[at : at + n], 2.0) == pytest.approx(cost(part, plain_viterbi(part, 2.0), 2.0), abs=1e-2)
        at += n


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(docs, model).where(langid.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.lang_score <= 1 for r in rows)


def test_spans_and_edges(spark):
    en, fr, ru = "the cat and the dog with those hats ", "les chats et les chiens dans une maison ", "и собака и кошка это хорошо "
    train = [(i, t * 3, l) for i in range(12) for t, l in ((en, "en"), (fr, "fr"), (ru, "ru"))] + [(99, None, "en"), (98, "zz", None)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(1, en * 5 + fr * 9), (2, ru), (3, None), (4, "12 !! 34"), (5, ""), (6, "漢字漢字"), (7, en), (7, en)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_score", F.lit("x")), model, penalty=4.0).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [s.lang for s in by[1].lang_spans] == ["en", "fr"] and by[1].lang_pred == "fr"
    assert by[2].lang_pred == "ru" and by[2].lang_score == 1
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert by[6].lang_pred in ("en", "fr", "ru") and by[6].lang_score == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, model).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows[:1], "doc_id long, text string"), langid.train(empty)).collect()] == ["und"]


def test_more_languages_than_a_byte_counts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [f"{letters[k % 26]}{letters[k // 26]}q" * 2 for k in range(200)]
    rows = [(i, f"{own[i]} {own[i]}x {own[i]}y " * 4, f"l{i:03d}") for i in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [(i, f"{own[i]} {own[i]}x " * 40 + f"{own[-1 - i]} {own[-1 - i]}y " * 50) for i in range(100)]
    got = {r.doc_id: [s.lang for s in r.lang_spans] for r in langid.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model, penalty=4.0).collect()}
    assert got == {i: [f"l{i:03d}", f"l{199 - i:03d}"] for i in range(100)}


def test_spans_of_mixed_texts(spark, sf):
    """Halves of held-out texts of two languages: nearly every word gets the label of its half."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    held = [r for r in docs.where(langid.held_out(F.col("doc_id"))).orderBy("doc_id").collect() if sum(c.isalpha() for c in r.text or "") > 200]
    pairs = [(k, a, b) for k, (a, b) in enumerate(zip(held, held[1:])) if a.lang != b.lang]
    rows = [(k, a.text[:3000] + "\n" + b.text[:3000]) for k, a, b in pairs]
    right = total = 0
    halves = spark.createDataFrame([(2 * k + j, x.text[:3000]) for k, *two in pairs for j, x in enumerate(two)], "doc_id long, text string")
    words = {r.doc_id: sum(s.n_words for s in r.lang_spans) for r in langid.identify(halves, model).collect()}
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        _, a, b = next(p for p in pairs if p[0] == r.doc_id)
        label = [s.lang for s in r.lang_spans for _ in range(s.n_words)]
        cut = words[2 * r.doc_id]
        right += sum(x == a.lang for x in label[:cut]) + sum(x == b.lang for x in label[cut:])
        total += len(label)
    assert len(pairs) >= 10 and right >= 0.95 * total


def test_very_long_texts(spark):
    train = [(i, t, l) for i in range(4) for t, l in (("the cat and the dog ", "en"), ("les chats et les chiens ", "fr"))]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([(1, "les chats et les chiens " * 90_000 + "the cat and the dog " * 20)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "fr" and [s.lang for s in got.lang_spans] == ["fr", "en"]
