"""Page text to typed blocks: paragraphs, wrapped lines, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import code, text

# Patterns of list markers and headings.
LIST_LINE = r"(?U)^(?:[-*•]|\d+[.)])\s+"
LIST_ITEM = r"(?s)(?U)^(?:[-*•]|(\d+)[.)])\s+(.*)$"
CHAPTER = r"(?U)^第\s*\d+\s*章"
DECIMAL = r"(?U)^(\d+(?:\.\d+)+)(?:\s|$)"
MAJOR = r"(?U)^\d+\s*[、．](?!\d)"
SENTENCE_END = r"[。！？.!?;；,，]\z"


def numbered_level(c: Column) -> Column:
    """Level by a decimal number: one more than its parts, six at most; null without one."""
    number = F.regexp_extract(c, DECIMAL, 1)
    return F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")) + 1))


def is_short_heading(c: Column) -> Column:
    words = F.size(F.filter(F.split(text.squeeze(c), " "), lambda w: w != ""))
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    shout = (letters != "") & (letters == F.upper(letters))
    return (c != "") & (F.length(c) <= 80) & ~c.rlike(SENTENCE_END) & F.when(shout, words <= 14).otherwise((F.length(c) <= 32) & (words <= 10))


def classify(c: Column, page: Column, index: Column) -> Column:
    """struct(type, level, text) of a paragraph; the first rule that fits decides."""
    flat = text.squeeze(c)
    item = F.regexp_extract(c, LIST_ITEM, 2)
    made = lambda kind, level, value: F.struct(F.lit(kind).alias("type"), (level if isinstance(level, Column) else F.lit(level)).cast("int").alias("level"), value.alias("text"))
    return (
        F.when(c.rlike(LIST_ITEM), made("list_item", None, text.strip(item)))
        .when((page == 1) & (index == 1) & (F.length(flat) <= 120), made("title", 1, flat))
        .when(flat.rlike(CHAPTER), made("heading", 1, flat))
        .when(flat.rlike(DECIMAL), made("heading", numbered_level(flat), flat))
        .when(flat.rlike(MAJOR), made("heading", 2, flat))
        .when(code.is_code_blob(c) | code.is_code_line(flat), made("code", None, c))
        .when(c.rlike(f"{text.WS}{{3,}}"), made("paragraph", None, flat))
        .when(is_short_heading(flat), made("heading", 2, flat))
        .otherwise(made("paragraph", None, flat))
    )


def paragraphs(c: Column) -> Column:
    """Array of paragraphs: cut at blank lines, list lines alone, other lines joined."""

    def pieces(chunk: Column) -> Column:
        lines = F.filter(F.transform(F.split(chunk, "\n", -1), text.strip), lambda x: x != "")
        # a fold that opens a group for each list line and after it
        start = F.array().cast("array<array<string>>")

        def step(groups: Column, line: Column) -> Column:
            last = F.get(groups, F.size(groups) - 1)
            alone = line.rlike(LIST_LINE) | (F.size(groups) == 0) | F.coalesce(F.get(last, F.lit(0)).rlike(LIST_LINE), F.lit(False))
            grown = F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(F.concat(last, F.array(line))))
            return F.when(alone, F.concat(groups, F.array(F.array(line)))).otherwise(grown)

        return F.transform(F.aggregate(lines, start, step), text.join_wrapped)

    chunks = F.split(text.newlines(c), r"(?U)\n\s*\n", -1)
    return F.flatten(F.transform(chunks, pieces))


def blocks(pages: DataFrame, text_col: str = "text", engine: str = "native") -> DataFrame:
    """Blocks of pages (doc_id, page and their text). A null text has none."""
    each = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.posexplode(paragraphs(F.col(text_col))).alias("i", "paragraph"))
    made = each.select("doc_id", "page", (F.col("i") + 1).cast("int").alias("seq"), classify(F.col("paragraph"), F.col("page"), F.col("i") + 1).alias("c"))
    return as_blocks(
        made.select("doc_id", "page", "seq", F.format_string("p%d-text-%d", "page", "seq").alias("block_id"), "c.type", "c.text", "c.level", F.lit(engine).alias("engine"))
    )


def as_blocks(rows: DataFrame) -> DataFrame:
    """`rows` with every column of blocks, null where they have none."""
    have = {c: rows.schema[c].dataType for c in rows.columns}
    return rows.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.BLOCKS))


def image_blocks(images: DataFrame, engine: str = "native") -> DataFrame:
    """Blocks for (doc_id, page, index, suffix) of extracted images, after the page's text blocks."""
    name = F.format_string("page-%04d-image-%03d%s", "page", "index", F.coalesce(F.nullif(F.lower("suffix"), F.lit("")), F.lit(".bin")))
    return as_blocks(
        images.select(
            "doc_id", "page", (F.lit(100_000) + F.col("index")).alias("seq"), F.format_string("p%d-image-%d", "page", "index").alias("block_id"), F.lit("image").alias("type"),
            F.format_string("第 %d 页图片 %d", "page", "index").alias("text"), F.concat(F.lit("assets/"), name).alias("asset_path"), F.lit(engine).alias("engine"),
        )
    )
