"""A training-text pipeline over the table documents.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame over all that the stage
before kept: language ID, line dedup, MinHash near-dedup, benchmark decontamination, and
byte-level BPE. All but the last return the columns of documents.

A document goes if it has no letter or no language holds half of its letters; if another
document of its class of near-duplicates has a smaller id; or if it covers half of a
benchmark item. Lines that go leave the document in place, with its n_chars made anew.
The last stage returns doc_id, lang, source, n_tokens, token_ids (unsigned 32-bit
little-endian) and decodes_back, whether decoding gives the text's bytes again.

Defined results: an empty table gives an empty result; rows with a null id have no class
and stay; a null text has no letter and goes in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, decontam, langid, lines, minhash
from quirefold.llm import queries as ops
from quirefold.storage import checkpoint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model)
    return found.where("lang_pred <> 'und' and lang_score >= 0.5").select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.drop_boilerplate(docs.select(*COLUMNS), "source")
    return found.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.where("not is_kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs.select(*COLUMNS), ops.table(spark, sf_dir, "benchmark"))
    return found.where("leak_item is null").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), *ops.vocabulary(), decode=False, check=True, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
# Signatures, per-word scores and merges have no SQL form; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ops.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
