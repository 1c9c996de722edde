import base64
import random

import pytest
from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_lines import brute as without_boilerplate
from test_minhash import brute as classes

import corpus_pipeline
from quirefold.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, boilerplate, leaks and texts without letters."""
    rng = random.Random(8)
    say = {"en": "the of and to in that with was this from have been their water people house".split(), "fr": "le la les des une dans avec pour être maison chien était cette vous nous monde".split()}
    rows, items = [], [(k, " ".join(f"item{k}word{j}" for j in range(20))) for k in range(5)]
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        text = "\n".join(" ".join(rng.choice(say[lang]) + (rng.choice("abcdef") if rng.random() < 0.5 else "") for _ in range(rng.randrange(4, 15))) for _ in range(rng.randrange(1, 6)))
        if rng.random() < 0.4:
            text = "Home | About | Contact\n" + text
        if rng.random() < 0.1:
            text += "\n" + rng.choice(items)[1]
        if i > 20 and rng.random() < 0.2:
            text = rng.choice(rows)[1] or ""
        rows.append((i, text, lang, f"src{i % 2}", len(text)))
    rows += [(200, None, "en", "src0", None), (201, "12 345 --", None, "src1", 9), (202, "", "fr", None, 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_against_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    path, rows, items = folder
    first = {r.doc_id for r in corpus_pipeline.identify_language(spark, queries.table(spark, path, "documents"), path).collect()}
    assert first == {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    kept = [(i, s, t) for i, t, _, s, _ in rows if i in first]
    text = {i: t for i, (t, _) in without_boilerplate(kept).items()}
    assert text != {i: t for i, _, t in kept}
    named = classes(list(text.items()))
    alone = {i: t for i, t in text.items() if named[i] == i}
    leaked = leaks(list(alone.items()), items)
    clean = {i: t for i, t in alone.items() if leaked[i][0] is None}
    assert len(clean) < len(alone) < len(text)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: b"".join(x.to_bytes(4, "little") for x in plain.encode_ordinary(t)) for i, t in clean.items()}
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: bytes(r.token_ids) for r in got} == want and len(got) == len(want)
    assert all(r.decodes_back and r.n_tokens == len(r.token_ids) // 4 for r in got)


def test_columns_and_empty_tables(spark, folder):
    path = folder[0]
    docs = queries.table(spark, path, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), path).count() == 0
    assert corpus_pipeline.encode(spark, docs.where(F.lit(False)), path).count() == 0
