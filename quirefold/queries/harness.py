"""Test harness, not product: the driver's documents as pages of blocks.

Plain prose leaves most rules cold, so lines are decorated by integer arithmetic on
(doc_id, pos), alike in Spark and in SQL: list items, numbered headings, code with and
without number tails, garble, table rows. A lossy primary engine drops some lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment
from ..storage import spread

PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select("doc_id", "pos", (F.floor(F.col("pos") / PAGE) + 1).cast("int").alias("page"), (F.col("pos") % PAGE).cast("int").alias("seq"), "line")


def _k(n: int) -> Column:
    return (F.col("doc_id") + F.col("pos")) % n == 0


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, page, seq, line, text)."""
    t = F.col("line")
    bare = lambda n: F.regexp_replace(F.left(t, F.lit(n)), '["|\\\\\\\\]', "")
    code = F.concat(F.lit('value = load("'), bare(24), F.lit('")'), F.when(_k(34), " 1 2 3 4 5").otherwise(""))
    outline = (F.col("doc_id") % 25 == 0) & (F.col("pos") % 2 == 1)
    text = (
        F.when(_k(11), F.concat(F.lit("- "), t))
        .when(_k(13) | outline, F.concat((F.col("pos") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(" "), F.left(t, F.lit(30))))
        .when(_k(51), F.concat(F.lit("return "), bare(10)))
        .when(_k(17), code)
        .when(_k(19), F.concat(t, F.lit("\ufffd" * 6)))
        .when(_k(31), F.concat(F.lit("| "), bare(8), F.lit(" | b |")))
        .when(_k(37), F.lit(");"))
        .otherwise(t)
    )
    return lines(spark, sf_dir).withColumn("text", text)


def blocks(spark: SparkSession, sf_dir: str, lossy: bool = True) -> DataFrame:
    """Blocks of the decorated lines. Headings of every fifth document have lost their levels."""
    own = decorated(spark, sf_dir)
    if lossy:
        own = own.where(~_k(23))
    outline = (F.col("doc_id") % 25 == 0) & (F.col("pos") % 2 == 1)
    code_first = _k(17) & ~(_k(11) | _k(13) | outline)
    row = _k(31) & ~(_k(11) | _k(13) | outline | _k(17) | _k(19))
    stray = _k(37) & ~(_k(11) | _k(13) | outline | _k(17) | _k(19) | _k(31))
    c = segment.classify(F.col("text"), F.col("page"), F.col("seq") + 1)
    kind = F.when(row, "table").when(code_first | stray, "code").otherwise(F.col("c.type"))
    body = F.when(row | code_first | stray, F.col("text")).otherwise(F.col("c.text"))
    level = F.when(F.col("type") == "heading", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(F.col("c.level")))
    made = own.withColumn("c", c).withColumn("type", kind)
    return segment.as_blocks(made.select("doc_id", "page", "seq", F.format_string("p%d-text-%d", "page", F.col("seq") + 1).alias("block_id"), "type", body.alias("text"), level.alias("level"), F.lit("primary").alias("engine")))


def plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback engine: every line, undecorated, as a paragraph."""
    return segment.as_blocks(
        lines(spark, sf_dir).select("doc_id", "page", "seq", F.format_string("p%d-text-%d", "page", F.col("seq") + 1).alias("block_id"), F.lit("paragraph").alias("type"), F.col("line").alias("text"), F.lit("plain").alias("engine"))
    )


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.sum(F.length(F.regexp_replace("line", r"\s", ""))).cast("long")
    return lines(spark, sf_dir).groupBy("doc_id", "page").agg(chars.alias("native_text_chars")).select("doc_id", "page", "native_text_chars", F.lit(0).alias("image_count"), (F.col("native_text_chars") == 0).alias("is_blank"))


# the same in SQL

LETTERS = r"[^0-9A-Za-z_\x{C0}-\x{24F}]+"


def sql_words(expr: str, words: list[str]) -> str:
    """How many words of a list are in a text, by Unicode word boundaries of the texts used here."""
    inside = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(regexp_split_to_array({expr}, '{LETTERS}'), lambda w: w IN ({inside})))"


# Words of the rules on code.
BLOB_WORDS = ["class", "def", "elif", "else", "for", "from", "if", "import", "print", "return", "try", "while", "with"]

LINES = f"""
lines AS (
  SELECT d.doc_id, t.pos - 1 AS pos, CAST((t.pos - 1) // {PAGE} + 1 AS INTEGER) AS page, CAST((t.pos - 1) % {PAGE} AS INTEGER) AS seq, t.line AS line
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS t(line, pos)
)"""

DECORATED = (
    LINES
    + r""",
decorated AS (
  SELECT *, doc_id + pos AS k, CASE
    WHEN (doc_id + pos) % 11 = 0 THEN '- ' || line
    WHEN (doc_id + pos) % 13 = 0 OR (doc_id % 25 = 0 AND pos % 2 = 1) THEN CAST(pos % 9 + 1 AS VARCHAR) || '.' || CAST(doc_id % 7 + 1 AS VARCHAR) || ' ' || left(line, 30)
    WHEN (doc_id + pos) % 51 = 0 THEN 'return ' || regexp_replace(left(line, 10), '["|\\]', '', 'g')
    WHEN (doc_id + pos) % 17 = 0 THEN 'value = load("' || regexp_replace(left(line, 24), '["|\\]', '', 'g') || '")' || CASE WHEN (doc_id + pos) % 34 = 0 THEN ' 1 2 3 4 5' ELSE '' END
    WHEN (doc_id + pos) % 19 = 0 THEN line || repeat(chr(65533), 6)
    WHEN (doc_id + pos) % 31 = 0 THEN '| ' || regexp_replace(left(line, 8), '["|\\]', '', 'g') || ' | b |'
    WHEN (doc_id + pos) % 37 = 0 THEN ');'
    ELSE line END AS text
  FROM lines
)"""
)

FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
NUMBER = "regexp_extract(flat, '^(\\d+(?:\\.\\d+)+)(?:\\s|$)', 1)"
SHORT = (
    "(flat <> '' AND length(flat) <= 80 AND NOT regexp_matches(flat, '[。！？.!?;；,，]$') AND CASE WHEN regexp_replace(flat, '[^A-Za-z]', '', 'g') <> '' "
    "AND regexp_replace(flat, '[^A-Za-z]', '', 'g') = upper(regexp_replace(flat, '[^A-Za-z]', '', 'g')) THEN len(string_split(flat, ' ')) <= 14 ELSE length(flat) <= 32 AND len(string_split(flat, ' ')) <= 10 END)"
)
BLOB = f"(length(text) >= 100 AND {sql_words('text', BLOB_WORDS)} + len(regexp_extract_all(text, '==|!=|<=|>=|=>|->|:=|[(){{}}\\[\\]=;]')) >= 4)"
CODE_LINE = "regexp_matches(flat, '^(print\\s*\\(|return(\\s|$)|raise(\\s|$)|import\\s+[\\w\\x{C0}-\\x{24F}]|from\\s+\\S+\\s+import\\s+[\\w\\x{C0}-\\x{24F}]|(async\\s+)?def\\s+[\\w\\x{C0}-\\x{24F}]+\\s*\\(|class\\s+[\\w\\x{C0}-\\x{24F}]+|if\\s+.+:|for\\s+.+:|while\\s+.+:)')"

CLASSIFIED = (
    DECORATED
    + f""",
flattened AS (SELECT *, {FLAT} AS flat FROM decorated),
classified AS (
  SELECT *, {NUMBER} AS number, CASE
    WHEN regexp_matches(text, '^([-*•]|\\d+[.)])\\s+') THEN 'list_item'
    WHEN page = 1 AND seq = 0 AND length(flat) <= 120 THEN 'title'
    WHEN {NUMBER} <> '' THEN 'heading'
    WHEN regexp_matches(flat, '^\\d+\\s*[、．]([^\\d]|$)') THEN 'heading'
    WHEN {BLOB} OR {CODE_LINE} THEN 'code'
    WHEN regexp_matches(text, '\\s{{3,}}') THEN 'paragraph'
    WHEN {SHORT} THEN 'heading'
    ELSE 'paragraph' END AS base_type
  FROM flattened
),
every_block AS (
  SELECT doc_id, pos, k, page, seq, CASE
      WHEN k % 11 = 0 OR k % 13 = 0 OR (doc_id % 25 = 0 AND pos % 2 = 1) THEN base_type
      WHEN k % 31 = 0 AND k % 17 <> 0 AND k % 19 <> 0 THEN 'table'
      WHEN k % 17 = 0 THEN 'code'
      WHEN k % 37 = 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 31 <> 0 THEN 'code'
      ELSE base_type END AS type,
    CASE WHEN base_type = 'list_item' THEN trim(regexp_replace(text, '^([-*•]|\\d+[.)])\\s+', '')) WHEN base_type = 'code' THEN text ELSE flat END AS base_text, text AS raw, number
  FROM classified
),
blocks AS (
  SELECT doc_id, pos, k, page, seq, type, CASE WHEN type IN ('table', 'code') THEN raw ELSE base_text END AS text,
    CASE WHEN type = 'heading' THEN CASE WHEN doc_id % 5 = 0 THEN 2 WHEN number <> '' THEN least(6, len(string_split(number, '.')) + 1) ELSE 2 END END AS level
  FROM every_block WHERE k % 23 <> 0
)"""
)
INSPECTIONS = """,
inspections AS (SELECT doc_id, page, CAST(sum(length(regexp_replace(line, '\\s', '', 'g'))) AS BIGINT) AS native_text_chars FROM lines GROUP BY doc_id, page)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"
