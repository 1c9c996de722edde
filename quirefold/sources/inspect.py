"""Files and pages before parsing: limits, kinds and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text

MAGIC = b"%PDF-"


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", max_bytes: int = S.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a folder. Sizes are filtered by the listing, before any content is read.

    Spark's reader passes over files of no bytes, so `empty` is only given for rows from elsewhere.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return accept(found, max_bytes)


def accept(found: DataFrame, max_bytes: int = S.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Split rows (path, length, content) into files with filename and sha256, and (path, reason)."""
    size = F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large")
    fit = found.where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    is_pdf = F.substring("content", 1, len(MAGIC)) == F.lit(MAGIC)
    accepted = fit.where(is_pdf).select("path", text.safe_filename(F.col("path")).alias("filename"), F.col("length").alias("file_size"), digest(F.col("content")).alias("sha256"), "content")
    rejected = found.select("path", size.alias("reason")).where("reason is not null").union(fit.where(~is_pdf).select("path", F.lit("not_pdf")))
    return accepted, rejected


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def rejection(length: Column, page_count: Column, max_bytes: int = S.MAX_FILE_BYTES, max_pages: int = S.MAX_PAGES) -> Column:
    """Why a document is refused by its size or page count; null if it is not."""
    return (
        F.when(length.isNull(), "missing").when(length == 0, "empty").when(length > max_bytes, "too_large").when(page_count == 0, "no_pages").when(page_count > max_pages, "too_many_pages")
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, native_text_chars, image_count, is_blank) of rows with text and image_count."""
    chars = F.length(text.compact(F.coalesce("text", F.lit("")))).cast("long")
    return pages.select("doc_id", "page", chars.alias("native_text_chars"), "image_count", ((chars == 0) & (F.col("image_count") == 0)).alias("is_blank"))


def bad_side(width: Column, height: Column) -> Column:
    """Whether a page's box has a side that no page can have."""
    return (F.least(width, height) <= 0) | (F.greatest(width, height) > S.MAX_PAGE_SIDE)


def turned(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(360)).cast("int")


def kinds(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, kind): born digital if every page has text, scanned if nearly all are images only."""
    texty = F.col("native_text_chars") >= S.PAGE_TEXT_CHARS
    image_only = ~texty & (F.col("image_count") > 0)
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(texty).alias("n_text"), F.count_if(image_only).alias("n_image"))
    most = F.greatest(F.lit(1), F.floor(F.col("page_count") * S.SCANNED_SHARE))
    kind = F.when(F.col("n_text") == F.col("page_count"), "born_digital").when(F.col("n_image") >= most, "scanned").when((F.col("n_text") > 0) | (F.col("n_image") > 0), "mixed").otherwise("unknown")
    return n.select("doc_id", "page_count", kind.alias("kind"))


def selected(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Only the pages that are asked for (doc_id, page); filter before an engine runs."""
    return pages.join(wanted.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
