"""Queries on Markdown output and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import client, render, segment
from ..sources import sinks
from . import gate
from . import harness as H

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


MARKDOWN = """,
markdown AS (SELECT *, CASE type WHEN 'title' THEN '# ' || trim(regexp_replace(text, '^#+', '')) WHEN 'heading' THEN repeat('#', level) || ' ' || trim(regexp_replace(text, '^#+', '')) WHEN 'list_item' THEN '- ' || text
  WHEN 'code' THEN '```' || chr(10) || rtrim(text) || chr(10) || '```' ELSE text END AS md FROM (SELECT doc_id, page, seq, type, level, CASE WHEN type = 'code' THEN text ELSE trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) END AS text FROM blocks))"""


@query("render_blocks", H.sql(H.CLASSIFIED + MARKDOWN, "SELECT doc_id, page, seq, md AS markdown FROM markdown WHERE md <> ''"))
def render_blocks(spark, d):
    return render.rendered(H.blocks(spark, d)).select("doc_id", "page", "seq", "markdown")


@query(
    "render_document",
    H.sql(H.CLASSIFIED + MARKDOWN, ", placed AS (SELECT *, lead(type) OVER (PARTITION BY doc_id ORDER BY page, seq) AS after FROM markdown WHERE md <> '') SELECT doc_id, trim(string_agg(md || CASE WHEN type = 'list_item' AND after = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY page, seq), chr(10) || ' ') || chr(10) AS markdown FROM placed GROUP BY doc_id").replace("\n, placed", ", placed"),
)
def render_document(spark, d):
    blocks = H.blocks(spark, d)
    return render.document(blocks, blocks.select("doc_id").distinct(), with_front_matter=False)


@query("front_matter", "SELECT doc_id, '---' || chr(10) || 'title: \"' || CASE WHEN doc_id % 2 = 0 THEN 'T \\\"' || lang || '\\\"' ELSE 'doc-' || doc_id END || '\"' || chr(10) || 'source: \"doc-' || doc_id || '.pdf\"' || chr(10) || 'pages: ' || (n_chars // 100) || chr(10) || 'document_kind: mixed' || chr(10) || 'source_sha256: ' || sha256(text) || chr(10) || '---' AS front_matter FROM documents")
def front_matter(spark, d):
    docs = H.table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('T "'), "lang", F.lit('"'))).otherwise("").alias("title"), F.floor(F.col("n_chars") / 100).alias("page_count"), F.lit("mixed").alias("kind"), F.sha2("text", 256).alias("sha256")
    )
    return docs.select("doc_id", render.front_matter().alias("front_matter"))


@query("clean_text", H.sql(H.LINES, "SELECT doc_id, string_agg(trim(regexp_replace(line, '[ \\t]+', ' ', 'g')), chr(10) ORDER BY pos) AS text FROM lines WHERE trim(line) <> '' GROUP BY doc_id"))
def clean_text(spark, d):
    docs = H.table(spark, d, "documents")
    noisy = F.concat(F.lit("\r\n \t "), F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\0\r"))
    return docs.select("doc_id", text.clean(noisy).alias("text"))


@query("clean_code", "SELECT doc_id, rtrim(replace(text, chr(10), chr(10) || '  ')) AS text FROM documents")
def clean_code(spark, d):
    noisy = F.concat(F.lit("\n  \n"), F.replace("text", F.lit("\n"), F.lit("  \r\n  ")), F.lit("  \n\n"))
    return H.table(spark, d, "documents").select("doc_id", text.clean_code(noisy).alias("text"))


@query("list_markers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3)' WHEN 1 THEN '1.' WHEN 2 THEN '*' ELSE '-' END AS marker FROM documents")
def list_markers(spark, d):
    marker = F.when(F.col("doc_id") % 4 == 0, " 3) ").when(F.col("doc_id") % 4 == 1, "x").when(F.col("doc_id") % 4 == 2, "*").otherwise("•")
    meta = F.struct((F.col("doc_id") % 4 < 2).alias("ordered"), marker.alias("marker"))
    return H.table(spark, d, "documents").select("doc_id", render.list_marker(meta).alias("marker"))


@query("joined_fragments", H.sql(H.LINES, ", n AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM lines) SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN rtrim(line) || ', ' || nxt ELSE rtrim(line) || ' ' || ltrim(nxt) END AS text FROM n WHERE nxt IS NOT NULL AND trim(line) <> '' AND trim(nxt) <> '' AND left(trim(nxt), 1) NOT IN ('.', ',', '!', '?', ';', ':', ')', ']', '}') AND right(trim(line), 1) NOT IN ('(', '[', '{')").replace("\n, n AS", ", n AS"))
def joined_fragments(spark, d):
    from pyspark.sql import Window

    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    own = H.lines(spark, d).withColumn("nxt", after).where("nxt is not null and trim(line) <> '' and trim(nxt) <> ''")
    own = own.where(~F.left(F.trim("nxt"), F.lit(1)).isin(*".,!?;:)]}") & ~F.right(F.trim("line"), F.lit(1)).isin(*"([{"))
    second = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(", "), "nxt")).otherwise(F.col("nxt"))
    return own.select("doc_id", F.col("pos").cast("long").alias("pos"), text.join_fragments(F.col("line"), second).alias("text"))


@query("preview", "SELECT doc_id, left(text, 100) AS preview FROM documents")
def preview(spark, d):
    whole = F.concat(F.lit("---\ntitle: x\n---\n"), "text")
    return H.table(spark, d, "documents").select("doc_id", client.preview(whole, 100).alias("preview"))


@query("bytes_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS VARCHAR) || ' MB' WHEN n_chars * 512 < 1048576 THEN CAST(CAST(n_chars / 2.0 AS DECIMAL(18, 1)) AS VARCHAR) || ' KB' ELSE 'large' END AS label FROM documents")
def bytes_labels(spark, d):
    n = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") + 1) * 1048576).otherwise(F.col("n_chars") * 512)
    label = client.bytes_label(n)
    large = (F.col("doc_id") % 3 != 0) & (n >= 1048576)
    return H.table(spark, d, "documents").select("doc_id", F.when(large, "large").otherwise(label).alias("label"))


@query("safe_filename", "SELECT page_id, coalesce(nullif(trim(left(regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '([^/]*)$', 1), 200)), ''), 'document.pdf') AS name FROM pages")
def safe_filename(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/", "\\\\")
    return H.table(spark, d, "pages").select("page_id", text.safe_filename(F.concat(F.lit("\0"), path)).alias("name"))


def asset_rows(spark, d):
    """Paths of each page of the web table, some of them not to be handed out."""
    k = F.col("page_id") % 6
    path = F.when(k == 0, "document.md").when(k == 1, "assets/a.png").when(k == 2, "../x").when(k == 3, "/etc/x").when(k == 4, "notes.txt").otherwise(F.concat(F.lit("assets/"), F.col("page_id").cast("string"), F.lit(".png")))
    return H.table(spark, d, "pages").select((F.col("page_id") % 50).alias("doc_id"), path.alias("path"), (F.col("page_id") % 4 != 3).alias("exists"))


ASSETS = "SELECT page_id % 50 AS doc_id, CASE page_id % 6 WHEN 0 THEN 'document.md' WHEN 1 THEN 'assets/a.png' WHEN 2 THEN '../x' WHEN 3 THEN '/etc/x' WHEN 4 THEN 'notes.txt' ELSE 'assets/' || page_id || '.png' END AS path, page_id % 4 <> 3 AS exists_, page_id % 6 AS k FROM pages"


@query("artifact_allowlist", f"SELECT DISTINCT doc_id, path FROM ({ASSETS}) WHERE exists_ AND k IN (0, 1, 5)")
def artifact_allowlist(spark, d):
    return sinks.allowed(asset_rows(spark, d))


@query(
    "manifest",
    H.sql(
        gate.DOCS,
        f""", paths AS (SELECT doc_id, path FROM ({ASSETS}) WHERE k IN (0, 1, 5) UNION SELECT DISTINCT doc_id, unnest(['document.json', 'document.md', 'manifest.json', 'quality-report.json']) FROM documents_),
files AS (SELECT doc_id, string_agg(path, ',' ORDER BY path) AS files FROM paths GROUP BY doc_id)
SELECT o.doc_id, '1.0' AS schema_version, 'doc-' || o.doc_id || '.pdf' AS source_filename, o.page_count, 'structured' AS primary_engine, o.score AS quality_score, o.passed AS quality_passed, f.files FROM documents_ o JOIN files f USING (doc_id)""",
    ).replace("\n, paths", ", paths"),
)
def manifest(spark, d):
    reports = gate.report(spark, d).documents
    docs = reports.select("doc_id", "page_count").withColumns({"filename": F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")), "sha256": F.lit(""), "kind": F.lit("mixed")})
    return sinks.manifest(docs, reports.drop("page_count"), asset_rows(spark, d)).drop("source_sha256", "document_kind")


@query("code_continuations")
def code_continuations(spark, d):
    """Code lines of the decorated documents, each going on from the one before."""
    from .. import schema

    goes_on = F.col("type") == "code"
    meta = F.struct(*((goes_on if f.name == "continues_previous" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.META))
    blocks = segment.as_blocks(H.blocks(spark, d).withColumn("meta", meta))
    return render.merge_continuations(blocks).where("type = 'code'").select("doc_id", "page", "seq", "text", "meta.language", F.array_join(F.transform("meta.continued_pages", lambda p: p.cast("string")), ",").alias("pages"))
