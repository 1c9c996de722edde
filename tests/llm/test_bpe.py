import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quirefold.llm import bpe


@pytest.fixture(scope="module")
def plain():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(spark, plain):
    rng = random.Random(2)
    parts = ["the", " quick", "é", "日本", "\U0001f600", "\n", "   ", "12", "'s", "'ll", "!?", "\t", "<|endoftext|>", "abcabc", "​", "ß", "A", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", "a" * 3000, " " * 2500 + "x", "ab!" * 2000, "é" * 700, "xyzzy" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        assert bytes(r.token_ids) == b"".join(i.to_bytes(4, "little") for i in plain.encode_ordinary(text))
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.token_ids) // 4


def test_edges(spark):
    v = P.path("byte_bpe_50k.tiktoken")
    assert bpe.encode_decode(spark.createDataFrame([], "text string"), v, P.PATTERN).count() == 0
    got = bpe.encode_decode(spark.createDataFrame([("a", 1), ("a", 1)], "text string, n_tokens int"), v, P.PATTERN, decode=False)
    assert got.columns == ["text", "n_tokens", "token_ids"] and [r.n_tokens for r in got.collect()] == [1, 1]


def test_matrix_equals_heap():
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    raws = [bytes(rng.choice(b"aabbeest ,") for _ in range(n)) for n in [*range(1, 60), 200, 200, 500]]
    assert [x.tolist() for x in codec.pieces(raws)] == [codec._heap(r).tolist() for r in raws]


def test_check_keeps_only_the_named_columns(spark):
    rows = [(1, "x", "a b c", 5), (2, None, None, 6), (3, "z", "é" * 900_000, 7), (4, "", "no", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, decodes_back int")
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=False, check=True, keep=["doc_id", "lang"])
    assert got.columns == ["doc_id", "lang", "n_tokens", "token_ids", "decodes_back"]
    assert {r.doc_id: (r.lang, r.decodes_back) for r in got.collect()} == {1: ("x", True), 2: (None, True), 3: ("z", True), 4: ("", True)}


def test_known_pre_tokens_are_bounded(monkeypatch, plain):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 2000)
    codec = bpe.ByteBPE(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for k in range(20):
        text = " ".join(f"word{k}x{j}" for j in range(200))
        assert codec.encode([text])[0].tolist() == plain.encode_ordinary(text) and codec.chars < 6000
