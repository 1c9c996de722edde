"""The quality gate: issues and scores of pages, and the verdict on a document.

Inspected pages are joined with what the parse made of them. Every rule is a column over
one row a page, so the deductions simply add up; only the rule on excess text reads the
other rules' error flags. Python is used for two questions alone, whether code parses and
whether HTML entities remain, and only on the rows that ask them.
"""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import code, tables, text
from ..storage import checkpoint

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
# Patterns of Python sources, console output and fences.
SOURCE_START = re.compile(r"(?m)^\s*(?:@[\w.]+|async\s+def\b|class\b|def\b|from\s+\S+\s+import\b|import\b)")
SOURCE_SIGNAL = re.compile(r"\b(?:async|await|class|def|elif|except|finally|for|from|if|import|lambda|raise|print|return|try|while|with|yield)\b|^\s*[A-Za-z_]\w*\s*=", re.M)
CONSOLE = re.compile(r"(?m)^\s*(?:Traceback\b|<class\s+['\"]|(?:[\w.]+\([^)]*\)|[A-Za-z_]\w*)(?:\s+[A-Za-z_]\w*=(?:'[^']*'|\"[^\"]*\"|[-+]?\d+(?:\.\d+)?)){2,})")
FENCE = re.compile(r"^\s*(`{3,}|~{3,})([^`]*)$")
NUMBERED = r"(?U)^\s*\d+(?:\.\d+)+"


def quality_text(kind: Column, body: Column, table_html: Column) -> Column:
    """A block's text; of a table with HTML, what is visible of that."""
    return F.when((kind == "table") & (F.coalesce(table_html, F.lit("")) != ""), text.html_visible(table_html)).otherwise(F.coalesce(body, F.lit("")))


# logical code


def scan_fences(raw: str) -> list[tuple[str, str, bool]]:
    """(language, body, unclosed) of each fenced block. A bare fence has the empty language."""
    out, opened, lang, body = [], None, "", []
    for line in raw.replace("\r\n", "\n").replace("\r", "\n").splitlines():
        if opened is None:
            m = FENCE.match(line)
            if m:
                opened, lang, body = m[1], (m[2].split() or [""])[0].casefold(), []
        elif line.strip() and set(line.strip()) == {opened[0]} and len(line.strip()) >= len(opened):
            out.append((lang, "\n".join(body), False))
            opened = None
        else:
            body.append(line)
    return out + ([(lang, "\n".join(body), True)] if opened is not None else [])


def fenced(blocks: DataFrame) -> DataFrame:
    """doc_id, page, seq, nth, block_id, language, body, unclosed of the fences in raw Markdown."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("language", T.StringType()), T.StructField("body", T.StringType()), T.StructField("unclosed", T.BooleanType())])))
    def scan(raw: pd.Series) -> pd.Series:
        return raw.map(lambda t: [{"language": a, "body": b, "unclosed": c} for a, b, c in scan_fences(t or "")])

    raw = blocks.where(F.col("type") == "raw_markdown")
    return raw.select("doc_id", "page", "seq", "block_id", F.posexplode(scan("text")).alias("nth", "f")).select("doc_id", "page", "seq", "nth", "block_id", "f.language", "f.body", "f.unclosed")


def code_stream(blocks: DataFrame) -> DataFrame:
    """Code blocks and raw fences in reading order; raw ones never take part in a continuation."""
    own = blocks.where(F.col("type") == "code").select(
        "doc_id", "page", "seq", F.lit(0).alias("nth"), "block_id", F.coalesce("meta.language", F.lit("")).alias("language"), F.coalesce("text", F.lit("")).alias("body"), F.lit(False).alias("unclosed"), F.lit(False).alias("raw"),
        F.coalesce("meta.continues_previous", F.lit(False)).alias("continues"), F.coalesce("meta.language_source", F.lit("")).alias("source"), (F.coalesce("meta.code_kind", F.lit("")) == "output").alias("is_output"),
        F.coalesce("meta.image_layout_recovered", F.lit(False)).alias("from_image"),
    )
    raw = fenced(blocks).select("*", F.lit(True).alias("raw"), F.lit(False).alias("continues"), F.lit("raw_markdown").alias("source"), F.lit(False).alias("is_output"), F.lit(False).alias("from_image"))
    return own.unionByName(raw)


def logical_groups(stream: DataFrame) -> DataFrame:
    """One row a logical code: a code block that continues joins the group before unless that is raw."""
    order = Window.partitionBy("doc_id").orderBy("page", "seq", "nth")
    start = F.col("raw") | ~F.col("continues") | F.coalesce(F.lag("raw").over(order), F.lit(True))
    numbered = stream.withColumn("_start", start.cast("int")).withColumn("grp", F.sum("_start").over(order))
    parts = F.array_sort(F.collect_list(F.struct("page", "seq", "nth", "body", "block_id", "language", "source")))
    grouped = numbered.groupBy("doc_id", "grp").agg(parts.alias("parts"), F.bool_or("raw").alias("raw"), F.bool_or("unclosed").alias("unclosed"), F.bool_or("is_output").alias("is_output"), F.bool_or("from_image").alias("from_image"))
    bodies = F.transform("parts", lambda p: F.regexp_replace(p["body"], r"[\n\r]+\z", ""))
    named = F.filter("parts", lambda p: p["language"] != "")
    out = grouped.select("*", F.array_join(bodies, "\n").alias("text"), F.coalesce(F.get(named, F.lit(0))["language"], F.lit("")).alias("declared"), F.get("parts", F.lit(0))["page"].alias("first_page"), F.get("parts", F.lit(0))["block_id"].alias("first_block_id"))
    candidates = F.concat(
        F.array(F.struct(F.col("declared").alias("language"), F.when(F.col("raw"), "raw_markdown").otherwise("").alias("source"))),
        F.transform("parts", lambda p: F.struct(F.when(F.col("raw"), F.lit("")).otherwise(p["language"]).alias("language"), p["source"].alias("source"))),
    )
    return out.withColumn("resolved", code.resolve_language(F.col("text"), candidates))


def line_page(parts: Column, line: Column) -> Column:
    """The page of a line of a logical code; a null line is on the first page."""
    step = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("used"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("last")),
        lambda s, p: F.struct(
            (s["used"] + F.size(F.split(p["body"], "\n", -1))).alias("used"),
            F.coalesce(s["page"], F.when(line <= s["used"] + F.size(F.split(p["body"], "\n", -1)), p["page"])).alias("page"),
            p["page"].alias("last"),
        ),
    )
    return F.when(line.isNull(), F.get(parts, F.lit(0))["page"]).otherwise(F.coalesce(step["page"], step["last"]))


def is_python_source(body: str, is_output: bool) -> bool:
    """Whether a text is worth parsing as Python: neither a printed object nor console output."""
    if is_output:
        return False
    if SOURCE_START.search(body):
        return True
    pairs = any(";" not in line and len(re.findall(r"\b[A-Za-z_]\w*\s*=", line)) >= 2 for line in body.splitlines())
    return not pairs and not CONSOLE.search(body) and len(SOURCE_SIGNAL.findall(body)) >= 2


def python_error(body: str) -> tuple[bool, int | None, str]:
    """(fails, line, reason) of parsing a text as Python."""
    try:
        ast.parse(body)
    except (SyntaxError, ValueError, TypeError) as e:
        return True, getattr(e, "lineno", None), getattr(e, "msg", None) or type(e).__name__
    except (RecursionError, MemoryError) as e:
        return True, None, type(e).__name__
    return False, None, ""


def json_error(body: str) -> tuple[bool, int | None, str]:
    try:
        json.loads(body)
    except (ValueError, TypeError, RecursionError) as e:
        return True, getattr(e, "lineno", None), type(e).__name__
    return False, None, ""


@F.pandas_udf(T.StructType([T.StructField("source", T.BooleanType()), T.StructField("fails", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("reason", T.StringType())]))
def _verdict(language: pd.Series, body: pd.Series, is_output: pd.Series) -> pd.DataFrame:
    out = []
    for lang, t, printed in zip(language, body, is_output):
        source = is_python_source(t, printed)
        failed = json_error(t) if lang == "json" else python_error(t) if source else (False, None, "")
        out.append((source, *failed))
    found = pd.DataFrame(out, columns=["source", "fails", "line", "reason"])
    return found.astype({"line": "Int32"})


def code_findings(blocks: DataFrame) -> DataFrame:
    """Logical groups with what was found in them: code (null if nothing), severity, deduction, page, and counts."""
    groups = logical_groups(code_stream(blocks))
    printed = F.col("is_output") | (code.code_kind(F.col("text")) == "output")
    asked = groups.withColumn("printed", printed).withColumn("v", _verdict(F.col("resolved"), F.col("text"), F.col("printed")))
    declared = code.language_name(F.col("declared"))
    language = F.when((declared == "") & (F.col("resolved") == "") & F.col("v.source"), F.lit("python")).otherwise(F.col("resolved"))
    g = asked.withColumn("language", language)
    n_lines = F.size(F.split("text", "\n", -1))
    python, is_json = (F.col("language") == "python") & F.col("v.source"), F.col("language") == "json"
    checked = F.col("unclosed") | python | is_json
    fails = ~F.col("unclosed") & (python | is_json) & F.col("v.fails")
    serious = (n_lines >= S.SYNTAX_ERROR_LINES) | F.col("raw") | (python & (F.size(F.array_distinct(F.transform("parts", lambda p: p["page"]))) > 1))
    found = (
        F.when(F.col("unclosed"), "unclosed_code_fence")
        .when(fails & python, F.when(F.col("from_image"), "image_ocr_syntax_warning").otherwise("python_syntax_error"))
        .when(fails, "json_syntax_error")
    )
    is_error = F.col("unclosed") | serious
    deduction = F.when(F.col("unclosed"), 25.0).when(python, F.when(serious, 25.0).otherwise(8.0)).otherwise(F.when(serious, 20.0).otherwise(6.0))
    return g.select(
        "doc_id", "grp", "first_page", "first_block_id", "language", declared.alias("declared"), "raw", "unclosed", "text", "parts",
        found.alias("code"), F.when(found.isNotNull(), is_error).otherwise(False).alias("is_error"), F.when(found.isNotNull(), deduction).otherwise(0.0).alias("deduction"),
        F.when(F.col("unclosed"), F.col("first_page")).otherwise(line_page(F.col("parts"), F.col("v.line"))).alias("page"),
        checked.alias("checked"), F.when(~F.col("unclosed") & (python | is_json), n_lines).otherwise(0).alias("source_lines"), F.col("v.line").alias("line"), F.col("v.reason").alias("reason"),
    )


def code_metrics(findings: DataFrame) -> DataFrame:
    """The nine metrics on code of each document."""
    n = lambda c: F.count_if(c).alias
    checked, invalid = F.count_if("checked"), F.count_if(F.col("code").isNotNull())
    return findings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("logical_code_block_count"),
        n(F.col("checked"))("checked_code_block_count"),
        n(F.col("code").isNotNull())("invalid_code_block_count"),
        n(F.col("declared") == "")("untyped_code_block_count"),
        n((F.col("declared") == "") & (F.col("language") != ""))("inferred_language_code_block_count"),
        n((F.col("declared") != "") & (F.col("language") != "") & (F.col("declared") != F.col("language")))("reclassified_language_code_block_count"),
        F.sum("source_lines").alias("source_code_line_count"),
        n(F.col("unclosed"))("unclosed_code_fence_count"),
        F.when(checked > 0, F.round((checked - invalid) / checked * 100, 2)).otherwise(100.0).alias("code_quality_score"),
    )


# rules on blocks


def maybe_collapsed(body: Column, meta: Column) -> Column:
    """Everything about a collapsed one-line code block but whether it parses."""
    short = text.strip(body)
    one_line = F.coalesce(meta["layout_recovered"] & (meta["start_line"] == meta["end_line"]), F.lit(False))
    language = F.coalesce(F.nullif(code.language_name(F.coalesce(meta["language"], F.lit(""))), F.lit("")), code.infer_language(short))
    return ~F.contains(short, F.lit("\n")) & (F.length(short) >= 60) & ~one_line & (code.statement_signals(short) >= 3) & (code.code_kind(short) == "") & (language == "python")


@F.pandas_udf(T.BooleanType())
def _does_not_parse(body: pd.Series) -> pd.Series:
    return body.map(lambda t: python_error((t or "").strip())[0])


def block_flags(blocks: DataFrame) -> DataFrame:
    """Blocks with what page rules need: qtext and flags."""
    kind, body = F.col("type"), F.coalesce("text", F.lit(""))
    is_code, is_table = kind == "code", kind == "table"
    size_known = F.coalesce(F.col("meta.table_rows") > 0, F.lit(False)) & F.coalesce(F.col("meta.table_columns") > 0, F.lit(False))
    filled = (body != "") | (F.coalesce("table_html", F.lit("")) != "")
    wrong = tables.mismatch(body, F.col("table_html"), F.col("meta.table_rows"), F.col("meta.table_columns"))
    aligned = F.coalesce(F.col("meta.image_layout_recovered") & (F.col("meta.image_layout_confidence") >= 0.9) & (F.col("meta.image_layout_similarity") >= 0.9), F.lit(False))
    heading = kind.isin("title", "heading")
    number = F.regexp_extract(body, NUMBERED, 0)
    level = F.when(kind == "title", 1).otherwise(F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(2)))
    expected = F.least(F.lit(6), F.size(F.split(number, r"\.")) + 1)
    return blocks.select(
        "doc_id", "page", "seq", "block_id", "type", "asset_path", "bbox",
        F.when(kind.isin(S.TEXT_TYPES), quality_text(kind, body, F.col("table_html"))).alias("qtext"),
        (is_code & F.coalesce("meta.image_layout_recovered", F.lit(False))).alias("from_image"),
        (is_code & aligned).alias("aligned"),
        (is_code & maybe_collapsed(body, F.col("meta"))).alias("maybe_collapsed"),
        (is_code & code.has_number_tail(body)).alias("number_tail"),
        (is_code & code.is_orphan(body)).alias("orphan"),
        (is_table & ~filled).alias("empty_table"),
        (is_table & filled & wrong).alias("mismatch"),
        (is_table & filled & ~wrong & size_known).alias("structured"),
        heading.alias("heading"),
        F.when(heading, level).alias("heading_level"),
        (heading & (number != "") & (level != expected)).alias("level_differs"),
        body.alias("body"),
    )


def collapsed(flags: DataFrame) -> DataFrame:
    """(doc_id, page, n) of collapsed code blocks; only candidates are parsed."""
    return flags.where("maybe_collapsed").where(_does_not_parse("body")).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_collapsed"))


LEVELS = [f"level_{k}" for k in range(1, 7)]


def page_facts(flags: DataFrame) -> DataFrame:
    """One row for each page that has blocks: counts, duplicate ratio, and lengths of its text."""
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("qtext").isNotNull(), F.struct("seq", "qtext")))), lambda s: s["qtext"])
    n = lambda c: F.count_if(c).alias
    facts = flags.groupBy("doc_id", "page").agg(
        texts.alias("texts"), n("from_image")("n_from_image"), F.bool_or("aligned").alias("aligned"), n("number_tail")("n_tail"), n("orphan")("n_orphan"), n("mismatch")("n_mismatch"), F.bool_or("structured").alias("structured"),
        F.array_sort(F.collect_list(F.when(F.col("empty_table"), F.coalesce("block_id", F.lit(""))))).alias("empty_tables"), n("level_differs")("n_level_differs"), *(n(F.col("heading_level") == k)(f"level_{k}") for k in range(1, 7)),
    )
    facts = facts.withColumn("normal", F.filter(F.transform("texts", text.normal), lambda x: x != "")).withColumn("page_text", text.strip(F.array_join("texts", "\n")))
    facts = facts.withColumn("packed", text.compact(F.col("page_text")))
    return facts.select(
        "doc_id", "page", F.lit(True).alias("has_blocks"), "n_from_image", "aligned", "n_tail", "n_orphan", F.size("empty_tables").cast("long").alias("n_empty"), "empty_tables", "n_mismatch", "structured", "n_level_differs", *LEVELS,
        F.when(F.size("normal") > 0, (F.size("normal") - F.size(F.array_distinct("normal"))) / F.size("normal")).otherwise(0.0).alias("dup"),
        F.length("packed").cast("long").alias("chars"),
        (F.length("packed") - F.length(F.replace("packed", F.lit("\ufffd"), F.lit("")))).cast("long").alias("n_garbled"),
        F.regexp_count("page_text", F.lit(CONTROL)).cast("long").alias("n_control"),
    )


def is_flat(counts: Column, n_differing: Column) -> Column:
    """Whether a document's headings, counted by level, have lost their levels."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    few = F.size(F.filter(counts, lambda x: x > 0)) <= S.FLAT_LEVELS
    return (n >= S.FLAT_HEADINGS) & (F.array_max(counts) / F.greatest(n, F.lit(1)) >= S.FLAT_DOMINANT) & few & (n_differing >= S.FLAT_MISMATCHES)


def with_flat(facts: DataFrame) -> DataFrame:
    """`facts` with n_flat: differing numbered headings of the document if its headings are flat, else 0."""
    doc = Window.partitionBy("doc_id")
    summed = facts.withColumns({f"all_{c}": F.sum(c).over(doc) for c in (*LEVELS, "n_level_differs")})
    flat = is_flat(F.array(*(F.col(f"all_{c}") for c in LEVELS)), F.col("all_n_level_differs"))
    return summed.select(*facts.columns, F.when(flat, F.col("all_n_level_differs")).otherwise(0).cast("long").alias("n_flat"))


def flat_headings(flags: DataFrame) -> DataFrame:
    """(doc_id, n_flat) of documents whose numbered headings have lost their levels."""
    sums = flags.where("heading").groupBy("doc_id").agg(F.count_if("level_differs").alias("n_flat"), *(F.count_if(F.col("heading_level") == k).alias(f"level_{k}") for k in range(1, 7)))
    return sums.where(is_flat(F.array(*map(F.col, LEVELS)), F.col("n_flat"))).select("doc_id", "n_flat")


@dataclass
class Report:
    """pages: scores; issues: one row each; documents: verdicts."""

    pages: DataFrame
    issues: DataFrame
    documents: DataFrame


def _step(n: Column, first: float, each: float, cap: float) -> Column:
    return F.when(n > 0, F.least(F.lit(cap), first + each * (n - 1))).otherwise(0.0)


def rules(page: DataFrame, minimum: float, native: bool) -> DataFrame:
    """Rows of joined facts -> score, flags and an array of (code, severity, block_id, deduction)."""
    c = F.col
    here = c("present")
    coverage = c("chars") / F.greatest(F.lit(1), c("native_text_chars"))
    measured = (c("native_text_chars") >= S.COVERAGE_FROM) & ~(~c("is_blank") & (c("chars") == 0))
    empty = ~c("is_blank") & (c("chars") == 0)
    base_error = c("flat_page") | c("code_error") | (c("n_collapsed") > 0) | (c("n_tail") > 0) | (c("n_orphan") >= 2) | (c("n_mismatch") > 0)
    excess = measured & (coverage > S.COVERAGE_EXCESS) & ~((coverage > S.COVERAGE_HIGH) & c("aligned"))
    explained = c("structured") & ~base_error & (c("dup") < S.DUPLICATE_RATIO)
    garbled, control = (c(k) / F.greatest(F.lit(1), c("chars")) for k in ("n_garbled", "n_control"))
    found: list[tuple[str, Column, Column | str, Column | float]] = [
        ("missing_page", ~here, "error", 100.0),
        ("duplicate_content", here & (c("dup") >= S.DUPLICATE_RATIO), "warning", 15.0),
        ("image_ocr_review_required", here & (c("n_from_image") > 0), "warning", F.when(c("aligned"), 0.0).otherwise(5.0)),
        ("collapsed_code_layout", here & (c("n_collapsed") > 0), "error", _step(c("n_collapsed"), 30.0, 5.0, 45.0)),
        ("line_number_contamination", here & (c("n_tail") > 0), "error", _step(c("n_tail"), 30.0, 5.0, 45.0)),
        ("orphan_code_fragment", here & (c("n_orphan") > 0), F.when(c("n_orphan") >= 2, "error").otherwise("warning"), F.when(c("n_orphan") >= 2, 25.0).otherwise(10.0)),
        ("tiny_asset", here & (c("n_tiny") > 0), "warning", F.least(F.lit(15.0), 5.0 * c("n_tiny"))),
        ("table_structure_mismatch", here & (c("n_mismatch") > 0), "error", _step(c("n_mismatch"), 30.0, 5.0, 40.0)),
        ("empty_output", empty, "error", 70.0),
        ("low_text_coverage", measured & (coverage < S.COVERAGE_LOW), "error", 30.0),
        ("reduced_text_coverage", measured & (coverage >= S.COVERAGE_LOW) & (coverage < S.COVERAGE_REDUCED), "warning", 12.0),
        ("recovered_image_text_expansion", measured & (coverage > S.COVERAGE_HIGH) & c("aligned"), "info", 0.0),
        ("excess_text_coverage", excess, F.when(explained, "warning").otherwise("error"), F.when(explained, 15.0).otherwise(30.0)),
        ("excess_text_coverage", measured & (coverage > S.COVERAGE_HIGH) & (coverage <= S.COVERAGE_EXCESS) & ~c("aligned"), "warning", 15.0),
        ("garbled_text", garbled > S.GARBLED_RATIO, "error", F.least(F.lit(S.GARBLED_CAP), garbled * S.RATIO_SLOPE)),
        ("control_characters", control > S.CONTROL_RATIO, "warning", F.least(F.lit(S.CONTROL_CAP), control * S.RATIO_SLOPE)),
    ]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    issues = F.filter(
        F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(k).alias("ord"), F.lit(name).alias("code"), as_column(sev).alias("severity"), as_column(off).cast("double").alias("deduction"))) for k, (name, when, sev, off) in enumerate(found))),
        lambda x: x.isNotNull(),
    )
    page = page.withColumn("found", issues)
    other = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["deduction"])
    other = other + F.when(here, 15.0 * c("n_empty") + 10.0 * c("n_missing_asset") + F.least(F.lit(S.FINDING_CAP), c("code_deduction")) + F.when(c("flat_page"), 25.0).otherwise(0.0)).otherwise(0.0)
    raw = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - other))
    error = base_error | (excess & ~explained)
    page = page.withColumn("raw_score", raw).withColumn("needs", ((F.col("raw_score") < minimum) | error) & ~c("is_blank")).withColumn("rounded", F.round("raw_score", 2))
    score = F.least(F.col("rounded"), F.lit(S.NATIVE_CAP)) if native else F.col("rounded")
    needs = c("needs") | ((score < minimum) & ~c("is_blank")) if native else c("needs")
    return page.withColumn("score", score).withColumn("needs_fallback", needs).withColumn("replacement_ratio", F.round(garbled, 5)).withColumn("duplicate_ratio", F.round("dup", 5))


def evaluate(
    inspections: DataFrame,
    blocks: DataFrame,
    parsed_pages: DataFrame | None = None,
    assets: DataFrame | None = None,
    minimum: float = S.MINIMUM_SCORE,
    engine: str = "structured",
    with_code: bool = True,
) -> Report:
    """The gate. `inspections`: rows of page_inspections; `parsed_pages` (doc_id, page): pages that the parse
    returned, by default those with a block; `assets` (doc_id, path, width, height): the files that exist.
    The scores are computed when this is called and kept in the checkpoint folder.
    `with_code=False` leaves out the two rules that parse code, and with them all Python.
    """
    flags = block_flags(blocks)
    key = ["doc_id", "page"]
    facts = with_flat(page_facts(flags))
    joined = inspections.select("doc_id", "page", "native_text_chars", "is_blank").join(facts, key, "left")
    if parsed_pages is not None:
        joined = joined.join(parsed_pages.select(*key).distinct().withColumn("present", F.lit(True)), key, "left")
    else:
        joined = joined.withColumn("present", F.coalesce("has_blocks", F.lit(False)))
    if with_code:
        findings = checkpoint(code_findings(blocks).select("doc_id", "page", "first_block_id", "code", "is_error", "deduction"))
        joined = joined.join(code_by_page(findings, *key), key, "left").join(collapsed(flags), key, "left")
    else:
        findings = None
        joined = joined.withColumns({"code_deduction": F.lit(0.0), "code_error": F.lit(False), "n_collapsed": F.lit(0).cast("long")})
    images = flags.where((F.col("type") == "image") & F.col("asset_path").isNotNull())
    if assets is not None:
        inside = ~F.col("asset_path").rlike(r"(^|/)\.\.(/|$)|^/")
        box_tiny = F.coalesce((F.abs(F.col("bbox.right") - F.col("bbox.left")) <= S.TINY_ASSET) & (F.abs(F.col("bbox.top") - F.col("bbox.bottom")) <= S.TINY_ASSET), F.lit(False))
        seen = images.join(assets.select("doc_id", F.col("path").alias("asset_path"), "width", "height", F.lit(True).alias("exists")), ["doc_id", "asset_path"], "left")
        ok = inside & F.col("exists").isNotNull()
        tiny = ok & (box_tiny | F.coalesce((F.col("width") <= S.TINY_ASSET) & (F.col("height") <= S.TINY_ASSET), F.lit(False)))
        checked = seen.select(*key, "block_id", (~ok).alias("missing"), tiny.alias("tiny"))
        joined = joined.join(checked.groupBy(*key).agg(F.count_if("missing").alias("n_missing_asset"), F.count_if("tiny").alias("n_tiny")), key, "left")
    else:
        checked = None
        joined = joined.withColumns({"n_missing_asset": F.lit(0).cast("long"), "n_tiny": F.lit(0).cast("long")})
    native = engine == "native"
    # a few numbers a page: written once, so that scores, issues and verdicts do not each read all texts
    scored = checkpoint(rules(complete(joined), minimum, native))
    page_quality = scored.select("doc_id", "page", "score", F.col("chars").alias("extracted_chars"), "replacement_ratio", "duplicate_ratio", "needs_fallback")
    issues = _issues(scored, findings, checked, native)
    return Report(page_quality, issues, _documents(page_quality, issues, minimum, engine))


def complete(joined: DataFrame) -> DataFrame:
    """Joined facts without gaps, with flat_page: pages without blocks are flat pages of no document, but
    their document's issue stands on its other pages."""
    zeros = ["n_from_image", "n_tail", "n_orphan", "n_empty", "n_mismatch", "n_level_differs", "chars", "n_garbled", "n_control", "n_collapsed", "n_missing_asset", "n_tiny"]
    filled = joined.na.fill(0, [*zeros, "n_flat"]).na.fill(0.0, ["dup", "code_deduction"]).na.fill(False, ["aligned", "structured", "present", "code_error"])
    return filled.withColumn("flat_page", (F.col("n_flat") > 0) & (F.col("n_level_differs") > 0))


def code_by_page(findings: DataFrame, *key: str) -> DataFrame:
    """(key, code_deduction, code_error)."""
    return findings.groupBy(*key).agg(F.sum("deduction").alias("code_deduction"), F.bool_or("is_error").alias("code_error"))


def _issues(scored: DataFrame, findings: DataFrame | None, assets: DataFrame | None, native: bool) -> DataFrame:
    """(doc_id, ord, page, block_id, code, severity, message); page is null for issues of the document.

    `ord` is the order of a report: the document's structure, then page by page, then limits of the engine.
    """
    none = F.lit(None).cast("string")
    place = lambda n: (F.col("page").cast("long") * 100 + n).alias("ord")
    rows = scored.select("doc_id", "page", F.explode("found").alias("i")).select("doc_id", place(F.col("i.ord")), "page", none.alias("block_id"), "i.code", "i.severity")
    rows = rows.union(scored.select("doc_id", "page", F.explode("empty_tables").alias("b")).select("doc_id", place(6), "page", "b", F.lit("empty_table"), F.lit("warning")))
    if assets is not None:
        rows = rows.union(assets.where("missing").select("doc_id", place(5), "page", "block_id", F.lit("missing_asset"), F.lit("warning")))
    if findings is not None:
        # by an explode: a filter would be pushed down with the whole expression of the finding
        severity = F.when(F.col("is_error"), "error").otherwise("warning")
        found = F.filter(F.array(F.struct(F.col("first_block_id").alias("block_id"), F.col("code"), severity.alias("severity"))), lambda x: x["code"].isNotNull())
        rows = rows.union(findings.select("doc_id", "page", F.explode(found).alias("f")).select("doc_id", place(3), "page", "f.*"))
    whole = F.lit(None).cast("int")
    rows = rows.union(scored.where("n_flat > 0").select("doc_id").distinct().select("doc_id", F.lit(0).cast("long"), whole, none, F.lit("flat_heading_hierarchy"), F.lit("error")))
    if native:
        rows = rows.union(scored.select("doc_id").distinct().select("doc_id", F.lit(2**62), whole, none, F.lit("limited_layout_validation"), F.lit("info")))
    return rows.withColumn("message", F.concat_ws(" ", F.replace("code", F.lit("_"), F.lit(" ")), F.when(F.col("page").isNotNull(), F.concat(F.lit("on page "), F.col("page").cast("string")))))


def overall(page_quality: DataFrame) -> DataFrame:
    """(doc_id, mean_score, low_score, overall): four fifths mean, one fifth mean of the lowest tenth."""
    doc = Window.partitionBy("doc_id")
    ranked = page_quality.withColumn("_n", F.count(F.lit(1)).over(doc)).withColumn("_r", F.row_number().over(doc.orderBy("score", "page")))
    low = F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * S.LOW_SHARE))
    out = ranked.groupBy("doc_id").agg(F.avg("score").alias("mean_score"), F.avg(F.when(low, F.col("score"))).alias("low_score"))
    return out.withColumn("overall", F.col("mean_score") * S.MEAN_WEIGHT + F.col("low_score") * S.LOW_WEIGHT)


def _documents(page_quality: DataFrame, issues: DataFrame, minimum: float, engine: str) -> DataFrame:
    per_page = page_quality.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_sort(F.collect_list(F.when(F.col("needs_fallback"), F.col("page")))).alias("fallback_pages"),
        F.sum("extracted_chars").alias("extracted_chars"),
    )
    counts = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("issue_count"), *(F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")))
    out = overall(page_quality).join(per_page, "doc_id").join(counts, "doc_id", "left").na.fill(0, ["issue_count", "error_count", "warning_count", "info_count"])
    return out.select(
        "doc_id", F.round("overall", 2).alias("score"), ((F.col("overall") >= minimum) & (F.col("error_count") == 0)).alias("passed"), F.lit(engine).alias("primary_engine"), "fallback_pages", F.size("fallback_pages").cast("long").alias("failed_pages"),
        "page_count", "issue_count", "error_count", "warning_count", "info_count", "extracted_chars", F.round("mean_score", 2).alias("mean_page_score"), F.round("low_score", 2).alias("low_decile_score"),
    )


def block_metrics(blocks: DataFrame) -> DataFrame:
    """The eleven block counts of each document."""
    kind = F.col("type")
    flag = lambda name: F.coalesce(F.col(f"meta.{name}"), F.lit(False))
    counts = {
        "heading_count": kind.isin("title", "heading"), "list_item_count": kind == "list_item", "table_count": kind == "table", "html_table_count": (kind == "table") & (F.coalesce("table_html", F.lit("")) != ""),
        "repaired_table_count": (kind == "table") & flag("table_alignment_repaired"), "code_block_count": kind == "code", "layout_recovered_code_blocks": (kind == "code") & flag("layout_recovered"),
        "image_ocr_code_blocks": (kind == "code") & flag("image_layout_recovered"), "image_count": (kind == "image") & (F.coalesce("asset_path", F.lit("")) != ""), "formula_count": kind == "formula",
    }
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("block_count"), *(F.count_if(c).alias(k) for k, c in counts.items()))


def confidence_metrics(confidence: DataFrame) -> DataFrame:
    """(doc_id, name, mean, low) of numeric engine confidences by page: rows (doc_id, page, values map<string,double>)."""
    each = confidence.select("doc_id", F.explode("values").alias("name", "value")).where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return each.groupBy("doc_id", "name").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("low"))
