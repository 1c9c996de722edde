"""Page text and earlier results as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from . import inspect, sinks

REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()), T.StructField("primary_engine", T.StringType()), T.StructField("fallback_pages", T.ArrayType(T.IntegerType())),
        *(T.StructField(c, T.LongType()) for c in ("failed_pages", "page_count", "issue_count", "error_count", "warning_count", "info_count", "extracted_chars")), T.StructField("mean_page_score", T.DoubleType()), T.StructField("low_decile_score", T.DoubleType()),
    ]
)


def text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, inspections) of text files, whose pages end with a form feed.

    A document's id is a hash of its path.
    """
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    named = whole.withColumn("doc_id", F.xxhash64("path"))
    pages = named.select("doc_id", F.posexplode(F.split("body", "\f", -1)).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("int").alias("page"), "text")
    facts = inspect.page_facts(pages.withColumn("image_count", F.lit(0)))
    about = named.select("doc_id", text.safe_filename(F.col("path")).alias("filename"), F.lit(None).cast("string").alias("title"), F.sha2("body", 256).alias("sha256"))
    return about.join(inspect.kinds(facts), "doc_id"), pages, facts


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Quality reports that sinks.write has written; a row that does not fit the schema fails the read."""
    return spark.read.schema(REPORT).option("mode", "FAILFAST").json(f"{path}/quality-report.json").select(*REPORT.names)


def result(spark: SparkSession, path: str, name: str, doc_id: int) -> DataFrame:
    """One document's rows of an artifact; only its bucket is read."""
    own = (F.col("part") == sinks.bucket(F.lit(doc_id))) & (F.col("doc_id") == doc_id)
    return spark.read.option("basePath", f"{path}/{name}").json(f"{path}/{name}").where(own).drop("part")
