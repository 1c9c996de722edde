"""Case folding, entities, engines that fail when they run, and passwords in options."""

import html
import random

from pyspark.sql import functions as F

from quirefold.functions import text
from quirefold.operators import jobs, segment
from quirefold.plans import convert
from quirefold.sources import engines


def test_fold_is_unicode_case_folding(spark):
    rows = ["", None, "ΌΔΟΣ ὀδούς", "ﬁne Straße STRASSE ẞ", "İstanbul", "ſhort µ", "Ꭰꭰ", "ŉ ǰ ΐ", "plain ASCII"] + [c for c in text.FOLDED if len(c.lower()) == 1]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", text.fold(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: t and t.casefold() if t is not None else None for i, t in enumerate(rows)}


def test_entities_resolve_as_in_html(spark):
    rng = random.Random(4)
    parts = ["&amp;", "&lt;", "&eacute;", "&copy", "&copyright;", "&notit;", "&#233;", "&#xE9;", "&#150;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999;", "&", "&;", "& b", "&nosuch;", "&CounterClockwiseContourIntegral;", "x", " ", "&amp;lt;", "&#65", "&hellip;", "&#39;", "&nbsp;", "&#xfdd0;", "&#12;"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.html_visible(F.col("t")).alias("v")).collect()
    want = {i: html.unescape(" ".join(t.split())) for i, t in enumerate(rows)}
    assert {i: (rows[i], v) for i, v in ((r.i, r.v) for r in got) if v != want[i]} == {}


def _documents(spark):
    pages = spark.createDataFrame([(1, 1, "This text is long enough to be read as a paragraph, is it not? It is.")], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, "r.pdf", "R", "ff", 1, "scanned")], "doc_id long, filename string, title string, sha256 string, page_count int, kind string")
    look = spark.createDataFrame([(1, 1, 900, False)], "doc_id long, page int, native_text_chars int, is_blank boolean")
    return docs, pages, look


def test_engines_that_fail_when_their_plan_runs(spark):
    asked = []

    def broken(message, until):
        def parse(pages):
            asked.append(message)
            if len(asked) > until:
                return segment.blocks(pages, engine="late")
            fail = F.raise_error(F.lit(message)).cast("string")
            return segment.blocks(pages, engine="late").withColumn("text", F.when(F.col("page") > 0, fail).otherwise(F.col("text")))

        return parse

    docs, pages, look = _documents(spark)
    try:
        engines.register(engines.Simulated("late", broken("Broken pipe", 1)))
        report = convert.convert(docs, pages, look, convert.Options(primary_engine="late")).report
        assert asked == ["Broken pipe"] * 2 and report.documents.first().primary_engine == "late"
        asked.clear()
        engines.register(engines.Simulated("late", broken("no such thing", 9)))
        report = convert.convert(docs, pages, look, convert.Options(primary_engine="late")).report
        assert asked == ["no such thing"] and report.documents.first().primary_engine == "native" and not report.documents.first().passed
        assert report.issues.orderBy("ord").first().code == "primary_engine_failed"
        asked.clear()
        engines.register(engines.Simulated("thin", lambda p: segment.blocks(p.where("page > 1"), engine="thin")))
        report = convert.convert(docs, pages, look, convert.Options(primary_engine="thin", fallback_engine="late")).report
        assert [r.code for r in report.issues.orderBy("ord").collect()][-1] == "fallback_failed"
        report = convert.convert(docs, pages, look, convert.Options(primary_engine="thin", fallback_engine="absent")).report
        assert [r.code for r in report.issues.orderBy("ord").collect()][-1] == "fallback_engine_unavailable"
    finally:
        for name in ("late", "thin"):
            engines.ENGINES.pop(name, None)


def test_no_password_stays_in_options(spark):
    rows = ['{"password": 12, "a": "x"}', '{"a": [1, "y"], "password": {"b": "c"}}', '{"password": "p\\"q"}', '{"password": ', None, '{"a": 1}']
    asked = spark.createDataFrame([(f"{i:032x}", "f.pdf", t, i) for i, t in enumerate(rows)], "id string, filename string, options_json string, created_at long")
    got = [r.options_json for r in jobs.inserted(asked).orderBy("id").collect()]
    assert got == ['{"a":"x"}', '{"a":[1,"y"]}', "{}", "{}", None, '{"a": 1}']
