"""Pages to Markdown with a quality gate: parse, repair, score, retry weak pages, render."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import layout, normalize, quality, render, select
from ..sources import engines, sinks
from ..storage import checkpoint

# What a transient failure says.
TRANSIENT = ("broken pipe", "connection reset", "resource temporarily unavailable", "temporarily unavailable", "unexpected eof")


@dataclass
class Options:
    primary_engine: str = "native"
    fallback_engine: str = "native"
    quality_fallback: bool = True
    minimum_score: float = S.MINIMUM_SCORE
    front_matter: bool = True
    page_markers: bool = False
    recover_layout: bool = True


@dataclass
class Result:
    blocks: DataFrame
    report: quality.Report
    markdown: DataFrame
    manifest: DataFrame
    chosen: DataFrame | None


def is_transient(error: Exception) -> bool:
    return any(s in str(error).casefold() for s in TRANSIENT)


def parse(name: str, pages: DataFrame) -> tuple[DataFrame, str, str | None]:
    """(blocks, engine used, issue): an absent or failing engine gives way to the native one, a transient failure is tried again.

    An engine's blocks are computed here, since most engines fail when their plan runs and not when it is made.
    """
    native = engines.engine("native")
    engine = engines.engine(name)
    if not engine.available():
        return native.parse(pages), native.name, "primary_engine_unavailable"
    if name == native.name:
        return native.parse(pages), name, None
    try:
        return _computed(engine, pages), name, None
    except Exception as first:
        if is_transient(first):
            try:
                return _computed(engine, pages), name, None
            except Exception:
                pass
    return native.parse(pages), native.name, "primary_engine_failed"


def _computed(engine: engines.Engine, pages: DataFrame) -> DataFrame:
    return checkpoint(engine.parse(pages))


def convert(documents: DataFrame, pages: DataFrame, inspections: DataFrame, options: Options | None = None) -> Result:
    """`documents`: doc_id, filename, title, sha256, page_count, kind; `pages`: doc_id, page, text; `inspections`: page_inspections."""
    o = options or Options()
    raw, used, issue = parse(o.primary_engine, pages)
    if o.recover_layout:
        layouts = pages.join(documents.where(F.col("kind").isin("born_digital", "mixed")), "doc_id", "left_semi").select("doc_id", "page", F.col("text").alias("layout_text"))
        raw, _ = layout.recover(raw, layouts)
    blocks = checkpoint(normalize.normalize(raw))
    report = quality.evaluate(inspections, blocks, minimum=o.minimum_score, engine=used)
    chosen, notices = None, [(issue, "warning", None)] if issue else []
    fallback = engines.ENGINES.get(o.fallback_engine)
    weak = report.pages.where("needs_fallback").select("doc_id", "page")
    if o.quality_fallback and fallback is not None and fallback.available() and fallback.name != used:
        try:
            second = checkpoint(normalize.normalize(fallback.parse(pages.join(weak, ["doc_id", "page"], "left_semi"))))
        except Exception:
            second = None
            notices.append(("fallback_failed", "warning", weak))
        if second is not None:
            chosen = select.better_pages(inspections, blocks, second, o.minimum_score, used, fallback.name, primary_pages=report.pages)
            blocks = checkpoint(select.merged(blocks, second, chosen))
            report = with_fallback(quality.evaluate(inspections, blocks, minimum=o.minimum_score, engine=used), weak, chosen, fallback.name)
            notices.append(("fallback_applied", "info", weak))
    elif o.quality_fallback and o.fallback_engine != "native" and (fallback is None or not fallback.available()):
        notices.append(("fallback_engine_unavailable", "warning", weak))
    for code, severity, only in notices:
        report = with_notice(report, code, severity, only, degraded=code == issue, last=code.startswith("fallback_") and severity == "warning")
    markdown = render.document(blocks, documents, o.front_matter, o.page_markers, pages=pages)
    assets = blocks.where("asset_path is not null").select("doc_id", F.col("asset_path").alias("path"))
    return Result(blocks, report, markdown, sinks.manifest(documents, report.documents.drop("page_count"), assets), chosen)


def with_fallback(report: quality.Report, tried: DataFrame, chosen: DataFrame, engine: str) -> quality.Report:
    """The report with the pages that were taken from the fallback as fallback_pages, and those tried."""
    listed = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias(name))
    none = F.array().cast("array<int>")
    out = report.documents.drop("fallback_pages").join(listed(chosen.where("applied"), "fallback_pages"), "doc_id", "left").join(listed(tried, "attempted_pages"), "doc_id", "left")
    out = out.withColumns({"fallback_pages": F.coalesce("fallback_pages", none), "attempted_pages": F.coalesce("attempted_pages", none)})
    return quality.Report(report.pages, report.issues, out.withColumn("fallback_engine", F.when(F.size("attempted_pages") > 0, engine)))


def with_notice(report: quality.Report, code: str, severity: str, only: DataFrame | None = None, degraded: bool = False, last: bool = False) -> quality.Report:
    """The report with a notice, before its other issues or after them, on every document or those of `only`; counts are made anew.

    A degraded conversion has not passed.
    """
    docs = report.documents.select("doc_id") if only is None else only.select("doc_id").distinct()
    row = docs.select("doc_id", F.lit(2**62 if last else -1).cast("long").alias("ord"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("block_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(code.replace("_", " ")).alias("message"))
    marked = report.documents.join(docs.withColumn("_noted", F.lit(1)), "doc_id", "left").withColumn("_noted", F.coalesce("_noted", F.lit(0)))
    made = {c: F.col(c) + F.col("_noted") for c in ("issue_count", f"{severity}_count")} | ({"passed": F.lit(False)} if degraded else {})
    return quality.Report(report.pages, row.unionByName(report.issues), marked.withColumns(made).drop("_noted"))
