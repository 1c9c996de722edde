"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of its host if more than `ratio` of the host's pages contain it,
and at least `min_pages` do; a line that one page alone has is no line of the site, however
small that is. Boilerplate lines are dropped from every page of the host;
the other lines stay in order, joined by newlines.

Lines are counted by a 64-bit hash of the whole line, once for each page, with map-side
combination, so that neither a hot host nor a hot line is gathered anywhere. A host has
fewer boilerplate lines than lines in its mean page divided by `ratio`, so each host's
list is bounded by its pages; all lists together are broadcast only if they hold at most
`broadcast_lines` lines, and otherwise joined by host and one of `SALTS` parts, so that a
hot host's pages are dealt over as many tasks. Texts are not shuffled in the first case.

Defined results: lines without a character other than a space or tab are never dropped.
A null text stays null and counts as a page. Pages of a null host keep every line. Every
row is a page of its own, repeated or not. Other columns pass through; `n_lines` and
`n_dropped` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint
from . import vector


#: Parts of a host's pages where lists are joined by host.
SALTS = 64


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): hashes of each host's boilerplate lines."""
    base = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text")).where("host is not null")
    totals = base.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = base.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where("line rlike '[^ \\t]'")
    counts = lines.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("n_pages"))
    return frequent.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.06, min_pages: int = 2, broadcast_lines: int = 200_000) -> DataFrame:
    """`pages` without boilerplate lines in `text_col`, with n_lines and n_dropped (long)."""
    pages = pages.drop("n_lines", "n_dropped")
    host, lines = vector.fresh(pages, "host_of_lines", "lines_to_drop")
    found = checkpoint(boilerplate(pages, host_col, text_col, ratio, min_pages)).toDF(host, lines)
    size = found.agg(F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()[0]
    same = pages[host_col] == F.col(host)
    if size <= broadcast_lines:
        found = F.broadcast(found)
    else:
        (salt,) = vector.fresh(pages, "part_of_host")
        found = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.pmod(F.xxhash64(*(pages[c] for c in pages.columns)), F.lit(SALTS)).cast("int") == F.col(salt))
    joined = pages.join(found, same, "left")
    split = F.split(F.col(text_col), "\n", -1)
    keep = F.filter(split, lambda x: ~(F.array_contains(F.col(lines), F.xxhash64(x)) & x.rlike("[^ \\t]")))
    # a host without boilerplate has a null list and keeps its text as it is
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n"))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    n_kept = F.when(F.col(text_col).isNull() | F.col(lines).isNull(), n_lines).otherwise(F.size(keep)).cast("long")
    return joined.select(*(text.alias(c) if c == text_col else pages[c] for c in pages.columns), n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def oracle(ratio: float = 0.06, min_pages: int = 2) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, source, t.line AS line, t.pos AS pos
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, pos)
), totals AS (
  SELECT source, count(*) AS n_pages FROM documents WHERE source IS NOT NULL GROUP BY source
), boilerplate AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source
  WHERE regexp_matches(l.line, '[^ \\t]')
  GROUP BY l.source, l.line, t.n_pages
  HAVING count(DISTINCT l.doc_id) >= {min_pages} AND count(DISTINCT l.doc_id) > {ratio} * t.n_pages
), kept AS (
  SELECT l.doc_id, count(*) AS n_kept, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN boilerplate b ON l.source = b.source AND l.line = b.line
  WHERE b.line IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n_kept, 0) END AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
