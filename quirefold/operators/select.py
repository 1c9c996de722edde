"""The better of two engines' pages.

Each page of the fallback is tried alone in the primary document. Of the rest of the document a
page's score depends on the headings, whose sums are the document's without the page, and on code
over page breaks: only code is expanded, once for each page tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import checkpoint
from . import quality, segment


def better_pages(inspections: DataFrame, primary: DataFrame, fallback: DataFrame, minimum: float = S.MINIMUM_SCORE, primary_engine: str = "structured", fallback_engine: str = "native", with_code: bool = True, primary_pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, primary_score, fallback_score, applied); applied only if strictly better.

    `primary_pages`: the primary's page scores, if they are known already.
    """
    key = ["doc_id", "page"]
    if primary_pages is None:
        primary_pages = quality.evaluate(inspections, primary, minimum=minimum, engine=primary_engine, with_code=with_code).pages
    own = primary_pages.select(*key, F.col("score").alias("primary_score"))
    flags = quality.block_flags(segment.as_blocks(fallback))
    counts = [*quality.LEVELS, "n_level_differs"]
    heads = quality.block_flags(segment.as_blocks(primary)).where("heading").groupBy(*key).agg(F.count_if("level_differs").alias("old_n_level_differs"), *(F.count_if(F.col("heading_level") == k).alias(f"old_level_{k}") for k in range(1, 7)))
    sums = heads.groupBy("doc_id").agg(*(F.sum(f"old_{c}").alias(f"all_{c}") for c in counts))
    facts = quality.page_facts(flags).join(sums, "doc_id", "left").join(heads, key, "left")
    facts = facts.withColumns({f"all_{c}": F.coalesce(f"all_{c}", F.lit(0)) - F.coalesce(f"old_{c}", F.lit(0)) + F.col(c) for c in counts})
    flat = quality.is_flat(F.array(*(F.col(f"all_{c}") for c in quality.LEVELS)), F.col("all_n_level_differs"))
    facts = facts.withColumn("n_flat", F.when(flat, F.col("all_n_level_differs")).otherwise(0).cast("long")).drop(*(f"{x}_{c}" for c in counts for x in ("all", "old")))
    none = F.lit(0).cast("long")
    joined = inspections.select(*key, "native_text_chars", "is_blank").join(facts, key).withColumns({"present": F.lit(True), "n_missing_asset": none, "n_tiny": none})
    if with_code:
        joined = joined.join(_tried_code(primary, fallback), key, "left").join(quality.collapsed(flags), key, "left")
    else:
        joined = joined.withColumns({"code_deduction": F.lit(0.0), "code_error": F.lit(False), "n_collapsed": none})
    theirs = quality.rules(quality.complete(joined), minimum, fallback_engine == "native").select(*key, F.col("score").alias("fallback_score"))
    out = theirs.join(own, key, "left").select(*key, F.coalesce("primary_score", F.lit(0.0)).alias("primary_score"), "fallback_score")
    return checkpoint(out.withColumn("applied", F.col("fallback_score") > F.col("primary_score")))


def _tried_code(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(doc_id, page, code_deduction, code_error) of each page tried, with the code of the document's other pages around it."""
    code = F.col("type").isin("code", "raw_markdown")
    # one document, with an id of its own, for each page tried; written, so that the ids stay
    many = checkpoint(fallback.select("doc_id", F.col("page").alias("tried")).distinct().withColumn("trial", F.monotonically_increasing_id()))
    columns = [c for c in S.BLOCKS.names if c != "doc_id"]
    kept = segment.as_blocks(primary).where(code).join(many, "doc_id").where("page <> tried").select(F.col("trial").alias("doc_id"), *columns)
    new = segment.as_blocks(fallback).where(code).withColumn("tried", F.col("page")).join(many, ["doc_id", "tried"]).select(F.col("trial").alias("doc_id"), *columns)
    found = quality.code_by_page(quality.code_findings(kept.unionByName(new)).select("doc_id", "page", "is_error", "deduction"), "doc_id", "page")
    return found.withColumnRenamed("doc_id", "trial").join(many, "trial").where("page = tried").select("doc_id", "page", "code_deduction", "code_error")


def merged(primary: DataFrame, fallback: DataFrame, chosen: DataFrame) -> DataFrame:
    """The primary's blocks, with the pages that `chosen` applies taken from the fallback."""
    taken = chosen.where("applied").select("doc_id", "page")
    key = ["doc_id", "page"]
    return segment.as_blocks(primary).join(taken, key, "left_anti").unionByName(segment.as_blocks(fallback).join(taken, key, "left_semi")).select(*S.BLOCKS.names)


def page_engines(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page").agg(F.min("engine").alias("engine"))
