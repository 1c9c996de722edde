"""Queries on the quality gate and on the choice between two engines."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text
from ..operators import client, quality, segment, select
from . import harness as H

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


NORMAL = "replace(replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ſ', 's')"
FACTS = (
    H.CLASSIFIED
    + H.INSPECTIONS
    + f""",
measured AS (
  SELECT *, {NORMAL.format('text')} AS normal, CASE WHEN type = 'title' THEN 1 ELSE level END AS lv, CASE WHEN type IN ('title', 'heading') THEN regexp_extract(text, '^\\s*\\d+(?:\\.\\d+)+') ELSE '' END AS num FROM blocks
),
differing AS (SELECT *, num <> '' AND lv <> least(6, len(string_split(num, '.')) + 1) AS level_differs FROM measured),
facts AS (
  SELECT doc_id, page, CASE WHEN count(*) FILTER (WHERE normal <> '') > 0 THEN (count(*) FILTER (WHERE normal <> '') - count(DISTINCT normal) FILTER (WHERE normal <> '')) / count(*) FILTER (WHERE normal <> '') ELSE 0 END AS dup,
    sum(length(regexp_replace(text, '\\s', '', 'g'))) AS chars, sum(length(text) - length(replace(text, chr(65533), ''))) AS n_garbled, count(*) FILTER (WHERE type = 'code' AND regexp_matches(text, '(^|\\s)\\d+([ \\t]+\\d+){{3,}}\\s*$')) AS n_tail,
    count(*) FILTER (WHERE type = 'code' AND text = ');') AS n_orphan, count(*) FILTER (WHERE type = 'table') AS n_mismatch, count(*) FILTER (WHERE level_differs) AS n_ld
  FROM differing GROUP BY doc_id, page
),
per_level AS (SELECT doc_id, lv, count(*) AS n, count(*) FILTER (WHERE level_differs) AS off FROM differing WHERE type IN ('title', 'heading') GROUP BY doc_id, lv),
flat AS (SELECT doc_id, sum(off) AS n_flat FROM per_level GROUP BY doc_id HAVING sum(n) >= 8 AND max(n) / sum(n) >= 0.9 AND count(*) <= 2 AND sum(off) >= 4),
joined AS (
  SELECT i.doc_id, i.page, i.native_text_chars AS native, i.native_text_chars = 0 AS blank, f.doc_id IS NOT NULL AS present, coalesce(f.dup, 0) AS dup, CAST(coalesce(f.chars, 0) AS BIGINT) AS chars, coalesce(f.n_garbled, 0) / greatest(1, coalesce(f.chars, 0)) AS garbled,
    coalesce(f.n_tail, 0) AS n_tail, coalesce(f.n_orphan, 0) AS n_orphan, coalesce(f.n_mismatch, 0) AS n_mismatch, coalesce(g.n_flat, 0) > 0 AND coalesce(f.n_ld, 0) > 0 AS flat_page, coalesce(g.n_flat, 0) > 0 AS flat_doc,
    coalesce(f.chars, 0) / greatest(1, i.native_text_chars) AS coverage
  FROM inspections i LEFT JOIN facts f USING (doc_id, page) LEFT JOIN flat g ON g.doc_id = i.doc_id
),
flagged AS (SELECT *, NOT blank AND chars = 0 AS is_empty, native >= 50 AND NOT (NOT blank AND chars = 0) AS measured, flat_page OR n_tail > 0 OR n_orphan >= 2 OR n_mismatch > 0 AS base_error FROM joined),
scored AS (
  SELECT *, greatest(0.0, least(100.0, 100.0 - (
      CASE WHEN NOT present THEN 100.0 ELSE 0 END + CASE WHEN present AND dup >= 0.2 THEN 15.0 ELSE 0 END + CASE WHEN n_tail > 0 THEN least(45.0, 30.0 + 5.0 * (n_tail - 1)) ELSE 0 END + CASE WHEN n_orphan >= 2 THEN 25.0 WHEN n_orphan = 1 THEN 10.0 ELSE 0 END
      + CASE WHEN n_mismatch > 0 THEN least(40.0, 30.0 + 5.0 * (n_mismatch - 1)) ELSE 0 END + CASE WHEN is_empty THEN 70.0 ELSE 0 END
      + CASE WHEN NOT measured THEN 0 WHEN coverage < 0.35 THEN 30.0 WHEN coverage < 0.65 THEN 12.0 WHEN coverage > 2.0 THEN 30.0 WHEN coverage > 1.6 THEN 15.0 ELSE 0 END
      + CASE WHEN garbled > 0.01 THEN least(35.0, garbled * 200.0) ELSE 0 END + CASE WHEN flat_page AND present THEN 25.0 ELSE 0 END))) AS raw_score
  FROM flagged
),
page_quality AS (
  SELECT doc_id, page, round(raw_score, 2) AS score, chars AS extracted_chars, round(garbled, 5) AS replacement_ratio, round(dup, 5) AS duplicate_ratio, (raw_score < 72 OR base_error OR (measured AND coverage > 2.0)) AND NOT blank AS needs_fallback FROM scored
),
issues AS (
  SELECT doc_id, page, unnest([
    CASE WHEN NOT present THEN 'missing_page:error' END, CASE WHEN present AND dup >= 0.2 THEN 'duplicate_content:warning' END, CASE WHEN n_tail > 0 THEN 'line_number_contamination:error' END,
    CASE WHEN n_orphan >= 2 THEN 'orphan_code_fragment:error' WHEN n_orphan = 1 THEN 'orphan_code_fragment:warning' END, CASE WHEN n_mismatch > 0 THEN 'table_structure_mismatch:error' END, CASE WHEN is_empty THEN 'empty_output:error' END,
    CASE WHEN measured AND coverage < 0.35 THEN 'low_text_coverage:error' WHEN measured AND coverage < 0.65 THEN 'reduced_text_coverage:warning' WHEN measured AND coverage > 2.0 THEN 'excess_text_coverage:error' WHEN measured AND coverage > 1.6 THEN 'excess_text_coverage:warning' END,
    CASE WHEN garbled > 0.01 THEN 'garbled_text:error' END]) AS issue FROM scored
  UNION ALL SELECT DISTINCT doc_id, CAST(NULL AS INTEGER), 'flat_heading_hierarchy:error' FROM scored WHERE flat_doc
),
named AS (SELECT doc_id, page, split_part(issue, ':', 1) AS code, split_part(issue, ':', 2) AS severity FROM issues WHERE issue IS NOT NULL)"""
)
DOCS = (
    FACTS
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, page) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM page_quality),
overall AS (SELECT doc_id, avg(score) AS mean_score, avg(score) FILTER (WHERE r <= greatest(1, ceil(n * 0.1))) AS low_score, count(*) AS page_count, count(*) FILTER (WHERE needs_fallback) AS failed_pages, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE needs_fallback), '') AS fallback_pages, CAST(sum(extracted_chars) AS BIGINT) AS extracted_chars FROM ranked GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS issue_count, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'info') AS info_count FROM named GROUP BY doc_id),
documents_ AS (SELECT o.doc_id, round(mean_score * 0.8 + low_score * 0.2, 2) AS score, mean_score * 0.8 + low_score * 0.2 >= 72 AND coalesce(error_count, 0) = 0 AS passed, fallback_pages, failed_pages, page_count, coalesce(issue_count, 0) AS issue_count, coalesce(error_count, 0) AS error_count, coalesce(warning_count, 0) AS warning_count, coalesce(info_count, 0) AS info_count, extracted_chars, round(mean_score, 2) AS mean_page_score, round(low_score, 2) AS low_decile_score FROM overall o LEFT JOIN counted c USING (doc_id))"""
)


def report(spark, d) -> quality.Report:
    return quality.evaluate(H.inspections(spark, d), H.blocks(spark, d), with_code=False)


@query("page_quality", H.sql(FACTS, "SELECT * FROM page_quality"))
def page_quality(spark, d):
    return report(spark, d).pages


@query("doc_quality", H.sql(DOCS, "SELECT * FROM documents_"))
def doc_quality(spark, d):
    return report(spark, d).documents.drop("primary_engine").withColumn("fallback_pages", F.array_join(F.transform("fallback_pages", lambda p: p.cast("string")), ","))


@query("quality_issues", H.sql(FACTS, "SELECT doc_id, page, code, severity FROM named"))
def quality_issues(spark, d):
    return report(spark, d).issues.select("doc_id", "page", "code", "severity")


@query("quality_severity_counts", H.sql(FACTS, "SELECT code, severity, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM named GROUP BY code, severity"))
def quality_severity_counts(spark, d):
    return report(spark, d).issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("fallback_pages", H.sql(FACTS, "SELECT doc_id, page FROM page_quality WHERE needs_fallback"))
def fallback_pages(spark, d):
    return report(spark, d).pages.where("needs_fallback").select("doc_id", "page")


@query("low_decile", H.sql(DOCS, "SELECT doc_id, mean_page_score, low_decile_score FROM documents_ WHERE page_count > 1"))
def low_decile(spark, d):
    many = report(spark, d).documents.where("page_count > 1")
    return many.select("doc_id", "mean_page_score", "low_decile_score")


@query("duplicate_lines", H.sql(H.LINES, f", n AS (SELECT doc_id, {NORMAL.format('line')} AS normal FROM lines) SELECT doc_id, count(*) - count(DISTINCT normal) AS n_duplicates, count(*) AS n_lines FROM n WHERE normal <> '' GROUP BY doc_id").replace("\n, n AS", ", n AS"))
def duplicate_lines(spark, d):
    own = H.lines(spark, d).withColumn("normal", text.normal(F.col("line"))).where("normal <> ''")
    return own.groupBy("doc_id").agg((F.count(F.lit(1)) - F.count_distinct("normal")).alias("n_duplicates"), F.count(F.lit(1)).alias("n_lines"))


@query("extracted_chars", H.sql(FACTS, "SELECT doc_id, page, chars FROM scored WHERE present"))
def extracted_chars(spark, d):
    return quality.page_facts(quality.block_flags(H.blocks(spark, d))).select("doc_id", "page", "chars")


@query("garbled_ratio", H.sql(FACTS, "SELECT doc_id, page, round(garbled, 6) AS garbled FROM scored WHERE present AND garbled > 0"))
def garbled_ratio(spark, d):
    facts = quality.page_facts(quality.block_flags(H.blocks(spark, d))).where("n_garbled > 0")
    return facts.select("doc_id", "page", F.round(F.col("n_garbled") / F.greatest(F.lit(1), "chars"), 6).alias("garbled"))


@query("control_ratio", H.sql(H.LINES, "SELECT doc_id, page, CAST(count(*) FILTER (WHERE (doc_id + pos) % 29 = 0) * 3 AS BIGINT) AS n_control FROM lines GROUP BY doc_id, page"))
def control_ratio(spark, d):
    marked = H.lines(spark, d).withColumn("text", F.concat("line", F.when((F.col("doc_id") + F.col("pos")) % 29 == 0, "\x01\x02\x05").otherwise("")))
    made = segment.as_blocks(marked.select("doc_id", "page", "seq", F.lit("paragraph").alias("type"), "text"))
    return quality.page_facts(quality.block_flags(made)).select("doc_id", "page", "n_control")


@query("coverage_bands", H.sql(FACTS, "SELECT CASE WHEN NOT measured THEN 'none' WHEN coverage < 0.35 THEN 'low' WHEN coverage < 0.65 THEN 'reduced' WHEN coverage > 2.0 THEN 'excess' WHEN coverage > 1.6 THEN 'high' ELSE 'good' END AS band, count(*) AS n FROM scored GROUP BY ALL"))
def coverage_bands(spark, d):
    facts = quality.page_facts(quality.block_flags(H.blocks(spark, d))).select("doc_id", "page", "chars")
    both = H.inspections(spark, d).join(facts, ["doc_id", "page"], "left").na.fill(0, ["chars"])
    share = F.col("chars") / F.greatest(F.lit(1), "native_text_chars")
    band = F.when((F.col("native_text_chars") < S.COVERAGE_FROM) | (F.col("chars") == 0), "none").when(share < S.COVERAGE_LOW, "low").when(share < S.COVERAGE_REDUCED, "reduced").when(share > S.COVERAGE_EXCESS, "excess").when(share > S.COVERAGE_HIGH, "high").otherwise("good")
    return both.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("block_metrics", H.sql(H.CLASSIFIED, "SELECT doc_id, count(*) AS block_count, count(*) FILTER (WHERE type IN ('title', 'heading')) AS heading_count, count(*) FILTER (WHERE type = 'list_item') AS list_item_count, count(*) FILTER (WHERE type = 'table') AS table_count, count(*) FILTER (WHERE type = 'code') AS code_block_count FROM blocks GROUP BY doc_id"))
def block_metrics(spark, d):
    return quality.block_metrics(H.blocks(spark, d)).select("doc_id", "block_count", "heading_count", "list_item_count", "table_count", "code_block_count")


@query("confidence_metrics", H.sql(H.LINES, ", v AS (SELECT doc_id, page, count(*) / 20.0 AS filled, CAST(page AS DOUBLE) AS depth FROM lines GROUP BY doc_id, page) SELECT doc_id, 'filled' AS name, round(avg(filled), 4) AS mean, round(min(filled), 4) AS low FROM v GROUP BY doc_id UNION ALL SELECT doc_id, 'depth', round(avg(depth), 4), round(min(depth), 4) FROM v GROUP BY doc_id").replace("\n, v", ", v"))
def confidence_metrics(spark, d):
    pages = H.lines(spark, d).groupBy("doc_id", "page").agg((F.count(F.lit(1)) / 20.0).cast("double").alias("n"))
    values = F.create_map(F.lit("filled"), F.col("n"), F.lit("depth"), F.col("page").cast("double"), F.lit("odd"), F.lit(float("nan")), F.lit("none"), F.lit(None).cast("double"))
    return quality.confidence_metrics(pages.select("doc_id", "page", values.alias("values")))


PLAIN = f""",
plain AS (SELECT doc_id, page, CASE WHEN count(*) FILTER (WHERE normal <> '') > 0 THEN (count(*) FILTER (WHERE normal <> '') - count(DISTINCT normal) FILTER (WHERE normal <> '')) / count(*) FILTER (WHERE normal <> '') ELSE 0 END AS dup FROM (SELECT doc_id, page, {NORMAL.format('line')} AS normal FROM lines) GROUP BY doc_id, page),
chosen AS (SELECT doc_id, page, q.score AS primary_score, CASE WHEN p.dup >= 0.2 THEN 85.0 ELSE 100.0 END AS fallback_score FROM page_quality q JOIN plain p USING (doc_id, page) WHERE q.needs_fallback)"""


def chosen(spark, d):
    scores = report(spark, d).pages
    second = H.plain_blocks(spark, d).join(scores.where("needs_fallback").select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return select.better_pages(H.inspections(spark, d), H.blocks(spark, d), second, fallback_engine="plain", with_code=False, primary_pages=scores), second


@query("better_page", H.sql(FACTS + PLAIN, "SELECT doc_id, page, primary_score, CAST(fallback_score AS DOUBLE) AS fallback_score, fallback_score > primary_score AS applied FROM chosen"))
def better_page(spark, d):
    return chosen(spark, d)[0]


@query("merged_pages", H.sql(FACTS + PLAIN, "SELECT f.doc_id, f.page, CASE WHEN c.doc_id IS NOT NULL AND c.fallback_score > c.primary_score THEN 'plain' ELSE 'primary' END AS engine FROM facts f LEFT JOIN chosen c USING (doc_id, page) UNION ALL SELECT c.doc_id, c.page, 'plain' FROM chosen c WHERE c.fallback_score > c.primary_score AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.doc_id = c.doc_id AND f.page = c.page)"))
def merged_pages(spark, d):
    picks, second = chosen(spark, d)
    return select.page_engines(select.merged(H.blocks(spark, d), second, picks))


@query("gate_vs_labels", H.sql(DOCS, "SELECT passed, quality, count(*) AS n FROM documents_ JOIN labels USING (doc_id) GROUP BY passed, quality"))
def gate_vs_labels(spark, d):
    """Verdicts against the table of labels: an analysis of ours."""
    return report(spark, d).documents.join(H.table(spark, d, "labels"), "doc_id").groupBy("passed", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("issues_by_page", H.sql(FACTS, "SELECT doc_id, page, code, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM named WHERE page IS NULL OR page = 1"))
def issues_by_page(spark, d):
    return client.issues_of_page(report(spark, d).issues, 1).select("doc_id", "page", "code", "rank")


@query("metrics_unpivot", H.sql(DOCS, "SELECT doc_id, 'page_count' AS metric, CAST(page_count AS DOUBLE) AS value FROM documents_ UNION ALL SELECT doc_id, 'failed_pages', CAST(failed_pages AS DOUBLE) FROM documents_ UNION ALL SELECT doc_id, 'score', score FROM documents_ WHERE passed"))
def metrics_unpivot(spark, d):
    docs = report(spark, d).documents.withColumn("score", F.when(F.col("passed"), F.col("score")))
    return client.metric_list(docs, ["page_count", "failed_pages", "score"])


# logical code

STREAM = """,
stream AS (SELECT doc_id, page, seq, k % 37 = 0 AS raw, k % 37 <> 0 AND pos % 3 <> 0 AS continues, text FROM blocks WHERE type = 'code'),
started AS (SELECT *, CAST(raw OR NOT continues OR coalesce(lag(raw) OVER (PARTITION BY doc_id ORDER BY page, seq), true) AS INTEGER) AS start FROM stream),
grouped AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY page, seq) AS grp FROM started)"""


def stream(spark, d):
    none = F.lit("")
    k, pos = F.col("doc_id") + (F.col("page") - 1) * H.PAGE + F.col("seq"), (F.col("page") - 1) * H.PAGE + F.col("seq")
    return H.blocks(spark, d).where("type = 'code'").select(
        "doc_id", "page", "seq", F.lit(0).alias("nth"), "block_id", none.alias("language"), F.col("text").alias("body"), F.lit(False).alias("unclosed"), (k % 37 == 0).alias("raw"), ((k % 37 != 0) & (pos % 3 != 0)).alias("continues"), none.alias("source"), F.lit(False).alias("is_output"), F.lit(False).alias("from_image")
    )


@query("logical_code_groups", H.sql(H.CLASSIFIED + STREAM, "SELECT doc_id, CAST(grp AS BIGINT) AS grp, count(*) AS n_parts, bool_or(raw) AS raw, min(page) AS first_page, string_agg(text, chr(10) ORDER BY page, seq) AS text FROM grouped GROUP BY doc_id, grp"))
def logical_code_groups(spark, d):
    return quality.logical_groups(stream(spark, d)).select("doc_id", "grp", F.size("parts").cast("long").alias("n_parts"), "raw", "first_page", "text")


@query("line_to_page", H.sql(H.LINES, "SELECT doc_id, CAST(greatest(1, least(max(page), (doc_id % 50) // 20 + 1)) AS INTEGER) AS page FROM lines GROUP BY doc_id"))
def line_to_page(spark, d):
    """The page of line doc_id mod 50, counted from one, where each page is a part of a logical code."""
    parts = H.lines(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n").alias("body"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("parts"))
    return whole.select("doc_id", quality.line_page(F.col("parts"), (F.col("doc_id") % 50 + 1).cast("int")).alias("page"))


# parsing code needs Python: rows only


def fenced_blocks(own):
    """Decorated lines in fences of raw Markdown; every seventh document's are left open."""
    lang = F.when(F.col("doc_id") % 3 == 0, "python").when(F.col("doc_id") % 3 == 1, "json").otherwise("")
    body = F.when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(F.col("pos").alias("n"), F.col("line").alias("t")))).otherwise(F.col("text"))
    raw = F.concat(F.lit("````"), lang, F.lit("\n"), body, F.when(F.col("doc_id") % 7 == 0, "").otherwise("\n````"))
    return segment.as_blocks(own.select("doc_id", "page", "seq", F.format_string("p%d-%d", "page", "seq").alias("block_id"), F.lit("raw_markdown").alias("type"), raw.alias("text")))


@query("fence_scan", H.sql(H.DECORATED, "SELECT doc_id, page, seq, CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'json' ELSE '' END AS language, doc_id % 7 = 0 AS unclosed FROM decorated"))
def fence_scan(spark, d):
    return quality.fenced(fenced_blocks(H.decorated(spark, d))).select("doc_id", "page", "seq", "language", "unclosed")


@query("code_findings")
def code_findings(spark, d):
    return quality.code_findings(fenced_blocks(H.decorated(spark, d))).select("doc_id", "grp", "page", "language", "code", "is_error", "deduction", "checked", "source_lines", "line")


@query("code_metrics")
def code_metrics(spark, d):
    return quality.code_metrics(quality.code_findings(fenced_blocks(H.decorated(spark, d))))


@query("python_syntax")
def python_syntax(spark, d):
    return quality.code_findings(H.blocks(spark, d)).where("language = 'python'").select("doc_id", "grp", "page", "code", "line")


@query("json_syntax", H.sql(H.DECORATED, "SELECT doc_id, page, CASE WHEN (doc_id + pos) % 2 = 0 THEN 'json_syntax_error' END AS code FROM decorated"))
def json_syntax(spark, d):
    own = H.decorated(spark, d)
    good = F.to_json(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b")))
    body = F.when((F.col("doc_id") + F.col("pos")) % 2 == 0, F.concat(good, F.lit(","))).otherwise(good)
    meta = F.struct(*((F.lit("json") if f.name == "language" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.META))
    made = segment.as_blocks(own.select("doc_id", "page", "seq", F.format_string("p%d-%d", "page", "seq").alias("block_id"), F.lit("code").alias("type"), body.alias("text"), meta.alias("meta")))
    return quality.code_findings(made).select("doc_id", "page", "code")


@query("collapsed_code", H.sql(H.DECORATED, "SELECT doc_id, page, count(*) AS n_collapsed FROM decorated WHERE pos % 2 = 0 GROUP BY doc_id, page"))
def collapsed_code(spark, d):
    """A small program for every line; half of them lose their newlines, the rest keep them."""
    own = H.decorated(spark, d)
    program = "import os\nfrom sys import path\ndef main(x):\n    return [y for y in x if y]\nvalue = main(path)\nprint(value)"
    body = F.when(F.col("pos") % 2 == 0, F.lit(program.replace("\n", " "))).otherwise(F.lit(program))
    made = segment.as_blocks(own.select("doc_id", "page", "seq", F.lit("code").alias("type"), body.alias("text")))
    return quality.collapsed(quality.block_flags(made))


@query("full_gate")
def full_gate(spark, d):
    """The whole gate, with the rules that parse code."""
    return quality.evaluate(H.inspections(spark, d), H.blocks(spark, d)).pages


