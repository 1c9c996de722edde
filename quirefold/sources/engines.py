"""Engines turn pages into blocks. An engine is a function of DataFrames, so that its
work is part of one plan; decoding PDF files needs a library that is optional here."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import geometry, tables, text
from ..operators import segment


class Engine(Protocol):
    """name, available() and parse(pages) -> blocks, of pages (doc_id, page, text)."""

    name: str

    def available(self) -> bool: ...

    def parse(self, pages: DataFrame) -> DataFrame: ...


class Native:
    """Blocks from the layout text of pages."""

    name = "native"

    def available(self) -> bool:
        return True

    def parse(self, pages: DataFrame) -> DataFrame:
        return segment.blocks(pages, engine=self.name)


class Simulated:
    """An engine for tests: any function of pages to blocks."""

    def __init__(self, name: str, make: Callable[[DataFrame], DataFrame], ready: bool = True):
        self.name, self._make, self._ready = name, make, ready

    def available(self) -> bool:
        return self._ready

    def parse(self, pages: DataFrame) -> DataFrame:
        return self._make(pages)


class Decoder:
    """Layout text of the pages of PDF files, where the optional library is installed."""

    library = "pypdf"

    def available(self) -> bool:
        return importlib.util.find_spec(self.library) is not None

    def pages(self, files: DataFrame) -> DataFrame:
        """(path, page, text, image_count) of rows with path and content."""
        if not self.available():
            raise RuntimeError(f"{self.library} is not installed: PDF files cannot be decoded here")

        def decode(batches):
            import io

            import pandas as pd
            from pypdf import PdfReader

            for pdf in batches:
                rows = []
                for path, content in zip(pdf["path"], pdf["content"]):
                    for n, page in enumerate(PdfReader(io.BytesIO(content), strict=False).pages, start=1):
                        try:
                            body = page.extract_text(extraction_mode="layout") or ""
                        except Exception:  # the library's layout mode fails on some files that its plain mode reads
                            body = page.extract_text() or ""
                        rows.append((path, n, body, len(page.images)))
                yield pd.DataFrame(rows, columns=["path", "page", "text", "image_count"])

        return files.select("path", "content").mapInPandas(decode, "path string, page int, text string, image_count int")


ENGINES: dict[str, Engine] = {"native": Native()}


def register(engine: Engine) -> None:
    ENGINES[engine.name] = engine


def engine(name: str) -> Engine:
    if name not in ENGINES:
        raise KeyError(f"no engine {name}; known: {', '.join(sorted(ENGINES))}")
    return ENGINES[name]


def statuses(spark: SparkSession) -> DataFrame:
    rows = [(n, e.available(), "fallback" if n == "native" else "primary") for n, e in sorted(ENGINES.items())]
    return spark.createDataFrame(rows, "name string, available boolean, role string")


# adapter of a structured engine's items

# Labels of items and the block types they become.
LABELS = {
    "title": "title", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list_item", "table": "table", "formula": "formula", "code": "code", "picture": "image",
    "caption": "caption", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer",
}


def block_type(label: Column) -> Column:
    name = F.element_at(F.split(F.lower(label), r"\."), -1)
    mapped = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(mapped, name), F.lit("paragraph"))


def items_to_blocks(items: DataFrame, engine_name: str = "docling", with_images: bool = True) -> DataFrame:
    """Blocks of a structured engine's items.

    `items`: doc_id, nth, label, text, prov array<struct<page_no,l,t,r,b>>, level, tree_level, enumerated, marker,
    code_language, num_rows, num_cols, cells array<struct<row_span,col_span>>, html, markdown. The first place counts; items
    without a page go; numbers are given before empty items go.
    """
    place = F.get("prov", F.lit(0))
    at = items.withColumn("page", F.nullif(place["page_no"], F.lit(0)).cast("int")).where("page is not null")
    from pyspark.sql import Window

    at = at.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("nth")).cast("int")).withColumn("type", block_type(F.col("label")))
    is_code, is_table, is_image, is_heading = (F.col("type") == t for t in ("code", "table", "image", "heading"))
    body = F.coalesce("text", F.lit(""))
    body = F.when(is_code, F.regexp_replace(body, r"^[\r\n]+|[\r\n]+\z", "")).otherwise(text.strip(body))
    spans = F.coalesce(F.exists("cells", lambda c: (F.coalesce(c["row_span"], F.lit(1)) > 1) | (F.coalesce(c["col_span"], F.lit(1)) > 1)), F.lit(False))
    rows, cols = (F.coalesce(c, F.lit(0)).cast("int") for c in ("num_rows", "num_cols"))
    markdown = F.when(is_table & ~spans, F.coalesce("markdown", body)).otherwise(body)
    valid = tables.is_valid(tables.shape(markdown), F.nullif(rows, F.lit(0)), F.nullif(cols, F.lit(0)))
    box = F.when(place["l"].isNotNull(), F.struct(*(place[k].cast("double").alias(n) for k, n in (("l", "left"), ("t", "top"), ("r", "right"), ("b", "bottom")))))
    shown = is_image & ~geometry.is_tiny_picture(box) & F.lit(with_images)
    semantic = F.coalesce("level", F.lit(1))
    language = F.lower(F.nullif(F.nullif(F.col("code_language"), F.lit("")), F.lit("unknown")))
    is_item = F.col("type") == "list_item"
    known = {
        "language": F.when(is_code, language), "language_source": F.when(is_code & language.isNotNull(), engine_name), "ordered": F.when(is_item, F.coalesce("enumerated", F.lit(False))), "marker": F.when(is_item, text.strip(F.coalesce(F.nullif("marker", F.lit("")), F.lit("-")))),
        "indent_level": F.when(is_item, F.greatest(F.lit(0), F.coalesce("tree_level", F.lit(0)) - 2)), "semantic_level": F.when(is_heading, semantic), "table_rows": F.when(is_table, rows), "table_columns": F.when(is_table, cols), "has_spans": F.when(is_table, spans),
    }
    meta = F.struct(*((known[f.name].cast(f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.META))
    name = F.format_string("assets/page-%04d-picture-%03d.png", "page", "seq")
    made = at.select(
        "doc_id", "page", "seq", F.format_string(f"p%d-{engine_name}-%d", "page", "seq").alias("block_id"), "type",
        F.when(is_table, markdown).when(is_image & (body == ""), F.format_string("第 %d 页图片", "page")).otherwise(body).alias("text"), box.alias("bbox"),
        F.when(is_heading, F.least(F.lit(6), F.greatest(F.lit(2), semantic + 1))).alias("level"), F.lit(engine_name).alias("engine"), F.when(shown, name).alias("asset_path"), F.when(is_table & (spans | ~valid), F.col("html")).alias("table_html"), meta.alias("meta"),
    )
    return segment.as_blocks(made.where(F.col("type").isin("table", "image") | (F.col("text") != "")))


def whole_document(blocks: DataFrame, documents: DataFrame, engine_name: str = "docling") -> DataFrame:
    """For documents (doc_id, page, markdown) without any block: one raw block on their lowest page."""
    first = documents.groupBy("doc_id").agg(F.min("page").alias("page"), F.min_by("markdown", "page").alias("text")).where(text.strip(F.coalesce("text", F.lit(""))) != "")
    bare = first.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti")
    raw = bare.select("doc_id", "page", F.lit(1).alias("seq"), F.format_string("p%d-raw", "page").alias("block_id"), F.lit("raw_markdown").alias("type"), "text", F.lit(engine_name).alias("engine"))
    return blocks.unionByName(segment.as_blocks(raw))


def recognised_pages(results: DataFrame, pages: DataFrame, engine_name: str = "paddleocr") -> DataFrame:
    """Raw blocks of an OCR engine whose i-th result belongs to the i-th selected page.

    `results`: doc_id, nth, texts array<string>; `pages`: doc_id, page.
    """
    from pyspark.sql import Window

    placed = pages.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1)
    joined = results.join(placed, ["doc_id", "nth"]).withColumn("text", text.strip(F.array_join(F.filter("texts", lambda t: text.strip(t) != ""), "\n\n"))).where("text <> ''")
    return segment.as_blocks(joined.select("doc_id", "page", F.lit(1).alias("seq"), F.format_string("p%d-ocr-1", "page").alias("block_id"), F.lit("raw_markdown").alias("type"), "text", F.lit(engine_name).alias("engine")))


def finite(confidence: DataFrame) -> DataFrame:
    """Engine confidences without values that JSON cannot hold: rows with values map<string,double>."""
    return confidence.withColumn("values", F.transform_values("values", lambda k, v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)))
