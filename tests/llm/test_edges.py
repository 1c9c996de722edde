"""Very long texts, and stages over tables with nulls everywhere and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm_quality import brute as counted

import corpus_pipeline
from quirefold.llm import decontam, licenses, minhash, quality, substring

DOCS = "doc_id long, text string"


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_near_duplicates_of_very_long_texts(spark):
    long, other = words(1, 200_000), words(2, 200_000)
    rows = [(1, " ".join(other)), (5, " ".join(long)), (6, " ".join(long[:-1] + ["end"])), (7, " ".join(long[:100_000])), (8, " ".join(long)), (9, "short")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 5: 5, 6: 5, 7: 7, 8: 5, 9: 9}


def test_passage_deep_in_a_very_long_text(spark):
    item, noise = words(3, 30), words(4, 300_000)
    rows = [(1, " ".join(noise + item[15:] + noise[:50] + item[:15])), (2, " ".join(noise))]
    found = decontam.decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.leak_item, r.leak_coverage) for r in found} == {1: (4, 1.0), 2: (None, 0.0)}


def test_repeated_passage_of_very_long_texts(spark):
    a, b = words(5, 120_000), words(6, 90_000)
    rows = [(1, " ".join(a)), (2, " ".join(b[:40_000] + a[10_000:110_000] + b[40_000:]))]
    for blocks in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup(spark.createDataFrame(rows, DOCS), blocks=blocks).collect()}
        assert got == {1: (120_000, 0, rows[0][1]), 2: (190_000, 100_000, " ".join(b))}


def test_counts_of_a_very_long_text(spark):
    w = words(7, 200_000)
    text = "\n".join([" ".join(w), " ".join(w[500:900]), "x", "x", " # ".join(w[:50])])
    (r,) = quality.judge(spark.createDataFrame([(1, text)], DOCS)).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(text)


def test_licence_at_the_end_of_a_very_long_text(spark):
    text = "\n".join(["plain words of a line"] * 100_000 + ["", "Released under the MIT License."])
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], DOCS), licenses.train(spark)).collect()
    assert r.n_paragraphs == 100_001 and [(x.paragraph, x.family) for x in r.licences] == [(100_000, "mit")]


CLASHING = ["id", "key", "node", "bucket", "buckets", "size", "a", "b", "class_id", "is_kept", "host", "line", "lines", "n_lines", "n_dropped", "leak_item", "lang_pred", "lang_score", "n_tokens", "token_ids", "item_id", "component"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls in every column and one very long text; a benchmark of one item."""
    say = "the of and to in that with was this from have been their water people house".split()
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(say) + rng.choice(["", "s", "ed"]) for _ in range(40)), "en", f"src{k % 2}", None) for k in range(30)]
    rows += [(40, "\n".join(" ".join(rng.choice(say) + str(k % 977) for _ in range(20)) for k in range(6_000)), "en", "src0", 1)]
    rows += [(41, rows[3][1], None, None, None), (None, rows[4][1], "en", "src1", 3), (None, None, None, None, None), (42, None, "en", None, 0), (43, "", None, "src0", 0)]
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1]), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_with_clashing_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    more = docs.select("*", *(F.lit(7).alias(c) for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES:
        plain, other = stage(spark, docs, tables), stage(spark, more, tables)
        assert plain.columns == other.columns, name
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.collect())), name


def test_run_with_nulls_and_a_very_long_text(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    ids = [r.doc_id for r in got]
    # 41 is a copy of 3, 7 is the benchmark's item, and texts without a letter go
    assert sorted(i for i in ids if i is not None) == [k for k in range(30) if k != 7] + [40] and ids.count(None) == 1
    assert all(r.decodes_back for r in got)
