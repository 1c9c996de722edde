"""The queries opN_<name>, one for each operator, over their whole tables.

Each takes its rows through its operator and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread
from . import bpe, decontam, langid, licenses, lines, minhash, quality, secrets, substring, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the splitting pattern, from the installed package of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    coded = bpe.encode_decode(docs, *vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, "source").select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("leak_item").isNotNull().alias("contaminated"), F.col("leak_item").alias("item_id"), F.col("leak_coverage").alias("coverage"), F.col("leak_items").alias("n_items"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    parsed = substring.dedup(docs, window=13)
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = secrets.scan(docs, secrets.train(docs))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", *map(number, secrets.KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = langid.identify(spread(docs.select("doc_id", "text"), "doc_id"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labels are those of its id: bad if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels, urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), licenses.train(spark))
    families = F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), F.array_join(families, ",").alias("families"), F.forall("licences", lambda x: x["confirmed"]).alias("all_confirmed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_lines": op2_lines,
        "op3_minhash": op3_minhash,
        "op4_decontam": op4_decontam,
        "op5_substring": op5_substring,
        "op6_secrets": op6_secrets,
        "op7_langid": op7_langid,
        "op8_quality": op8_quality,
        "op9_urls": op9_urls,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_lines": lines.oracle(),
        "op5_substring": substring.oracle(),
    }
