"""Segmentation, repair, layout and OCR recovery, tables, code functions and rendering."""

import pytest
from helpers import blocks, inspections
from pyspark.sql import functions as F

from quirefold.functions import code, python, tables
from quirefold.functions import text as fn
from quirefold.operators import layout, normalize, ocr, render, segment, select
from quirefold.plans import convert
from quirefold.sources import engines, inspect, readers, sinks


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expr.alias("v")).first().v


def test_segmentation(spark):
    page = "Title\n\n- one\n2) two\nwrapped hyphen-\nated line\n中文\n断行\n\n1.2.3 Deep\n\n3、Major\n\n第 4 章 End\n\nimport os\n\na   b   gap\n\nALL CAPS WORDS HERE\n\nThis one is a sentence."
    rows = segment.blocks(spark.createDataFrame([(1, 1, page), (1, 2, None), (2, 1, "")], "doc_id long, page int, text string")).orderBy("seq").collect()
    assert [(r.type, r.level, r.text) for r in rows] == [
        ("title", 1, "Title"), ("list_item", None, "one"), ("list_item", None, "two"), ("heading", 2, "wrapped hyphenated line 中文断行"), ("heading", 4, "1.2.3 Deep"), ("heading", 2, "3、Major"), ("heading", 1, "第 4 章 End"),
        ("code", None, "import os"), ("paragraph", None, "a b gap"), ("heading", 2, "ALL CAPS WORDS HERE"), ("paragraph", None, "This one is a sentence."),
    ]


LANGUAGES = ["const x = 1", "interface A { b: String }", "import os\nprint(x)", "@dec\nx = foo(1)", '{"a": 1}', "SELECT a", "$ ls\necho hi", "public class A", "#include <x>", "plain words", "from here it goes", "", "   [1]", "x.invoke(a)\ny = b.c"]


@pytest.mark.parametrize("t", LANGUAGES)
def test_language_columns_agree_with_the_python_form(spark, t):
    assert one(spark, code.infer_language(F.col("t")), t=t) == python.infer_language(t)


def test_languages(spark):
    assert [python.infer_language(t) for t in LANGUAGES[:9]] == ["javascript", "typescript", "python", "python", "json", "sql", "bash", "java", "cpp"]
    assert python.resolve_language("SELECT 1", [("Py ", None), ("json", "Docling")]) == "json"
    assert python.resolve_language("words", [("", ""), ("JSON5", None)]) == "json"
    assert python.code_kind("  HumanMessage(content='x')") == "output" and python.code_kind("HumanMessage(1)") == ""


@pytest.mark.parametrize("t, rows, columns, separator, valid", [
    ("| a | b |\n| :--- | ---: |\n| 1 | 2 |", 2, [2, 2, 2], 1, True), ("| a \\| b | c |\n|---|---|\n| `x\\|y` | z |", 2, [2, 2, 2], 1, True), ("|a|b|\n|---|---|\n|1|2|3|", 2, [2, 2, 3], 1, False),
    ("|a|b|\n|1|2|", 2, [2, 2], None, False), ("no pipe\n|a|", 0, [], None, False), ("a\\\\|b\n---|---\n1|2", 2, [2, 2, 2], 1, True), ("|\n", 0, [], None, False),
])
def test_pipe_tables(spark, t, rows, columns, separator, valid):
    s = one(spark, tables.shape(F.col("t")), t=t)
    assert (s.rows, s.columns, s.separator_index) == (rows, columns, separator)
    assert one(spark, tables.is_valid(tables.shape(F.col("t"))), t=t) == valid


def test_html_tables(spark):
    html = "<table><tr><td colspan='2'>a</td><th>b</th></tr><TR class=x><td>1</td><td>2</td><td>3</td></TR></table>"
    assert one(spark, tables.html_columns(F.col("t")), t=html) == [3, 3]
    assert one(spark, fn.html_visible(F.col("t")), t="<p>a &amp;lt; <b>b</b></p>\n c&quot;") == 'a &lt; b c"'
    check = lambda r, c: one(spark, tables.mismatch(F.lit(""), F.col("t"), F.lit(r), F.lit(c)), t=html)
    assert not check(2, 3) and check(3, 3) and check(2, 2)


def test_heading_levels(spark):
    rows = [{"type": "heading", "text": "第1章 A"}, {"type": "heading", "text": "2、B"}, {"type": "heading", "text": "2.1 C"}, {"type": "heading", "text": "2.1.1 D"}, {"type": "caption", "text": "方法 1：E"}, {"type": "heading", "text": "free", "level": 6}, {"type": "caption", "text": "Figure 1"}]
    got = normalize.heading_levels(blocks(spark, rows)).orderBy("seq").collect()
    assert [(r.type, r.level) for r in got] == [("heading", 1), ("heading", 2), ("heading", 3), ("heading", 4), ("heading", 5), ("heading", 5), ("caption", None)]


def test_inline_fragments_merge_and_items_stay_apart(spark):
    rows = [
        {"type": "list_item", "text": "name", "box": (10, 100, 50, 90)}, {"type": "paragraph", "text": "：value", "box": (55, 100, 90, 90)}, {"type": "paragraph", "text": "goes on", "box": (12, 85, 90, 75)},
        {"type": "list_item", "text": "next.", "box": (10, 70, 90, 60)}, {"type": "paragraph", "text": "label: x", "box": (11, 55, 90, 45)}, {"type": "heading", "text": "key", "box": (10, 40, 30, 30)}, {"type": "list_item", "text": ": v", "box": (35, 40, 60, 30)},
    ]
    got = normalize.merge_fragments(blocks(spark, rows)).orderBy("seq").collect()
    assert [(r.type, r.text) for r in got] == [("list_item", "name：value goes on"), ("list_item", "next."), ("list_item", "label: x"), ("list_item", "key: v")]
    assert got[0].meta.merged_block_ids == ["b1", "b2"] and got[3].meta.merged_heading_label and got[2].meta.promoted_from_paragraph


def test_shifted_role_table(spark):
    table = '| 角色 | 字典 | 对象 | 用途 | 备注 |\n|---|---|---|---|---|\n| System {"a": 1} | SystemMessage(x) | 为模型 | 设定规则 | n |\n| User | {"b": 2} | HumanMessage(y) | p | q |'
    got = normalize.repair_role_tables(blocks(spark, [{"type": "table", "text": table}, {"type": "paragraph", "text": "角色 字典"}])).orderBy("seq").collect()
    assert '| System | {"a": 1} | SystemMessage(x) | 设定规则为模型 | n |' in got[0].text and got[0].meta.table_alignment_repaired_rows == ["System"]
    assert got[1].text == "角色 字典"


def test_numbered_listing(spark):
    raw = "Intro text\n\n  1  def f(x):\n  2      if x:\n  3\n  4          return g(x,\n                 y)\n  5  print(f(1))"
    flat = "def f(x): if x: return g(x, y) print(f(1)) 1 2 3 4 5"
    made, stats = layout.recover(blocks(spark, [{"type": "paragraph", "text": "Intro text"}, {"type": "code", "text": flat, "box": (80, 700, 500, 500)}]), spark.createDataFrame([(1, 1, raw)], "doc_id long, page int, layout_text string"))
    code_block = made.where("type = 'code'").first()
    assert code_block.text == "def f(x):\n    if x:\n\n        return g(x,y)\nprint(f(1))"
    assert (code_block.meta.start_line, code_block.meta.end_line, code_block.meta.language) == (1, 5, "python")
    s = stats.first()
    assert (s.candidates_found, s.blocks_recovered) == (1, 1)


def test_numbered_prose_is_left_alone(spark):
    raw = "1  First we open the door\n2  Then we walk inside\n3  Then we sit down"
    rows = [{"type": "paragraph", "text": "First we open the door Then we walk inside Then we sit down"}]
    made, stats = layout.recover(blocks(spark, rows), spark.createDataFrame([(1, 1, raw)], "doc_id long, page int, layout_text string"))
    assert made.first().type == "paragraph" and stats.first().candidates_found == 1 and stats.first().blocks_recovered == 0


def test_listing_goes_on_over_the_page(spark):
    body = lambda a: "\n".join(f"{k:3d}  value_{k} = call({k})" for k in range(a, a + 3))
    rows = [{"type": "code", "page": p, "text": " ".join(f"value_{k} = call({k})" for k in range(a, a + 3))} for p, a in ((1, 1), (2, 4), (3, 9))]
    made, stats = layout.recover(blocks(spark, rows), spark.createDataFrame([(1, p, body(a)) for p, a in ((1, 1), (2, 4), (3, 9))], "doc_id long, page int, layout_text string"))
    assert [r.meta.continues_previous for r in made.orderBy("page").collect()] == [None, True, None]
    assert layout.recovery_totals(stats, made).first().cross_page_continuations == 1


def test_aligned_table_and_plain_code(spark):
    raw = "Name      Count    Price\nApple     3        10\nPear      4        12\n\n\n\n\nfor x in items:\n    total = total + x[1]\n    print(total)"
    rows = [{"type": "code", "text": "Name Count Price Apple 3 10 Pear 4 12"}, {"type": "code", "text": "for x in items: total = total + x[1] print(total)"}]
    made, stats = layout.recover(blocks(spark, rows), spark.createDataFrame([(1, 1, raw)], "doc_id long, page int, layout_text string"))
    got = made.orderBy("seq").collect()
    assert got[0].type == "table" and got[0].text.splitlines()[1] == "| --- | --- | --- |" and (got[0].meta.table_rows, got[0].meta.table_columns) == (3, 3)
    assert got[1].text == "for x in items:\n    total = total + x[1]\n    print(total)" and stats.first().layout_tables_recovered == 1


def test_ocr_rebuild_and_recovery(spark):
    lines = [(1, 0, "def main(a, b):"), (2, 40, "value = compute(a, b)"), (4, 40, "return value"), (5, 0, "print(main(1, 2), flush=True)")]
    boxes = [ocr.Box(5, 15, 20 * n, 20 * n + 14, str(n), 0.99) for n, _, _ in lines] + [ocr.Box(40 + x, 40 + x + 10 * len(t), 20 * n, 20 * n + 14, t, 0.9) for n, x, t in lines]
    made = ocr.rebuild(boxes)
    assert made["text"] == "def main(a, b):\n    value = compute(a, b)\n\n    return value\nprint(main(1, 2), flush=True)" and made["line_numbers_removed"]
    assert ocr.repair(["f(a,", "C", "x = 1"])[0] == ["f(a,", ")", "x = 1"] and ocr.repair(["f(a", "C", "x = 1"])[0][1] == "C"
    flat = "1 def main(a, b): 2 value = compute(a, b) 4 return value 5 print(main(1, 2), flush=True)"
    rows = [{"type": "code", "text": flat, "box": (0, 150, 400, 0)}, {"type": "code", "text": "short", "box": (0, 150, 400, 0)}]
    images = spark.createDataFrame([(1, 1, "i", 400.0, 150.0, [400.0, 0.0, 0.0, 150.0, 0.0, 0.0])], "doc_id long, page int, image_id string, width double, height double, placement array<double>")
    found = spark.createDataFrame([("i", *map(float, (b.left, b.right, b.top, b.bottom)), b.text, b.confidence) for b in boxes], "image_id string, left double, right double, top double, bottom double, text string, confidence double")
    got = ocr.recover(blocks(spark, rows), images, found).orderBy("seq").collect()
    assert got[0].text == made["text"] and got[0].meta.image_layout_recovered and got[0].meta.language == "python" and got[1].text == "short"


def test_rendering(spark):
    rows = [
        {"type": "title", "text": " My  Doc "}, {"type": "list_item", "text": "a", "meta": {"ordered": True, "marker": "3)"}}, {"type": "list_item", "text": "b", "meta": {"indent_level": 1, "marker": "•"}}, {"type": "paragraph", "text": "中 文\n\n x"},
        {"type": "code", "text": "\n  a ```` b\u00a0\n\n", "meta": {"language": "py<thon"}}, {"type": "formula", "text": "$$x^2$$"}, {"type": "image", "text": "a]b", "asset_path": "assets/a b.png"}, {"type": "image", "text": "gone"}, {"type": "page_footer", "text": "9"},
        {"type": "caption", "text": "cap"}, {"type": "footnote", "text": "note"}, {"type": "table", "text": "t", "table_html": " <table></table> "}, {"type": "raw_markdown", "text": "\n**x**\n"},
    ]
    docs = spark.createDataFrame([(1, "dir.x.pdf", None, "ab", 2, "mixed")], "doc_id long, filename string, title string, sha256 string, page_count int, kind string")
    got = render.document(blocks(spark, rows), docs).first().markdown
    assert got == (
        '---\ntitle: "dir.x"\nsource: "dir.x.pdf"\npages: 2\ndocument_kind: mixed\nsource_sha256: ab\n---\n# My Doc\n\n3) a\n  - b\n\n中文\nx\n\n`````python\n  a ```` b\n`````\n\n$$\nx^2\n$$\n\n![a\\]b](assets/a%20b.png)\n\n*cap*\n\n> note\n\n<table></table>\n\n**x**\n'
    )


def test_page_markers(spark):
    rows = [{"type": "list_item", "text": "a", "page": 2}, {"type": "paragraph", "text": "b", "page": 2}, {"type": "paragraph", "text": "c", "page": 4}]
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4)], "doc_id long, page int")
    got = render.body(blocks(spark, rows), True, pages).first().body
    assert got == "<!-- page: 1 -->\n\n<!-- page: 2 -->\n\n- a\n\nb\n\n<!-- page: 3 -->\n\n<!-- page: 4 -->\nc\n\n"


def test_code_continues_over_noise(spark):
    rows = [
        {"type": "code", "text": "def f():\n", "page": 1, "meta": {"language": "text"}}, {"type": "paragraph", "text": " 12 ", "page": 1}, {"type": "paragraph", "text": "kept", "page": 1}, {"type": "code", "text": "\n    return import_x", "page": 2, "meta": {"continues_previous": True}},
        {"type": "raw_markdown", "text": "r", "page": 2}, {"type": "code", "text": "y", "page": 2, "meta": {"continues_previous": True}},
    ]
    got = render.merge_continuations(blocks(spark, rows)).orderBy("page", "seq").collect()
    assert [r.type for r in got] == ["code", "paragraph", "raw_markdown", "code"]
    assert got[0].text == "def f():\n    return import_x" and got[0].meta.continued_pages == [1, 2] and (got[0].meta.language, got[0].meta.language_source) == ("python", "merged_inference")
    body = render.body(render.merge_continuations(blocks(spark, rows)), page_markers=True).first().body
    assert "<!-- page: 1 -->\n<!-- code spans pages: 1, 2 -->\n\n```python" in body


def test_better_page_must_be_strictly_better(spark):
    first = blocks(spark, [{"type": "paragraph", "text": "a" * 30, "page": 1}, {"type": "paragraph", "text": "b" * 100, "page": 2}])
    second = blocks(spark, [{"type": "paragraph", "text": "a" * 100, "page": 1, "engine": "other"}, {"type": "paragraph", "text": "b" * 100, "page": 2, "engine": "other"}, {"type": "paragraph", "text": "c" * 90, "page": 3, "engine": "other"}])
    chosen = select.better_pages(inspections(spark, {1: 100, 2: 100, 3: 100}), first, second, fallback_engine="other")
    assert {r.page: (r.primary_score, r.fallback_score, r.applied) for r in chosen.collect()} == {1: (70, 100, True), 2: (100, 100, False), 3: (0, 100, True)}
    assert {r.page: r.engine for r in select.page_engines(select.merged(first, second, chosen)).collect()} == {1: "other", 2: "test", 3: "other"}


def test_conversion(spark):
    pages = spark.createDataFrame([(1, 1, "Report\n\nThis text is long enough to be read as a paragraph, is it not? It is."), (1, 2, "lost")], "doc_id long, page int, text string")
    docs = spark.createDataFrame([(1, "r.pdf", "R", "ff", 2, "born_digital")], "doc_id long, filename string, title string, sha256 string, page_count int, kind string")
    lossy = engines.Simulated("lossy", lambda p: segment.blocks(p.where("page = 1"), engine="lossy"))
    flaky = {"n": 0}

    def unsteady(p):
        flaky["n"] += 1
        if flaky["n"] == 1:
            raise OSError("Broken pipe")
        return segment.blocks(p, engine="unsteady")

    for e in (lossy, engines.Simulated("unsteady", unsteady), engines.Simulated("absent", unsteady, ready=False)):
        engines.register(e)
    try:
        look = inspections(spark, {1: 62, 2: 4})
        got = convert.convert(docs, pages, look, convert.Options(primary_engine="lossy", fallback_engine="native"))
        about = got.report.documents.first()
        assert (about.fallback_engine, about.fallback_pages, about.attempted_pages, about.info_count) == ("native", [2], [2], 1)
        assert got.report.issues.orderBy("ord").first().code == "fallback_applied"
        assert got.chosen.first().applied and "lost" in got.markdown.first().markdown and got.manifest.first().files.startswith("document.json,document.md")
        got = convert.convert(docs, pages, look, convert.Options(primary_engine="unsteady"))
        assert flaky["n"] == 2 and got.report.documents.first().primary_engine == "unsteady"
        got = convert.convert(docs, pages, look, convert.Options(primary_engine="absent"))
        assert not got.report.documents.first().passed and got.report.issues.where("code = 'primary_engine_unavailable'").count() == 1
    finally:
        for name in ("lossy", "unsteady", "absent"):
            engines.ENGINES.pop(name)


def test_files_and_adapter(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"text"), ("c.pdf", b""), ("d.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(content)
    ok, bad = inspect.files(spark, str(tmp_path), max_bytes=50)
    assert [r.filename for r in ok.collect()] == ["a.pdf"]
    assert {r.path.rsplit("/")[-1]: r.reason for r in bad.collect()} == {"b.pdf": "not_pdf", "d.pdf": "too_large"}
    rows = spark.createDataFrame([("x/e.pdf", 0, b""), ("x/f.pdf", 6, b"%PDF-2")], "path string, length long, content binary")
    assert [r.reason for r in inspect.accept(rows)[1].collect()] == ["empty"] and inspect.accept(rows)[0].first().file_size == 6
    if not engines.Decoder().available():
        with pytest.raises(RuntimeError):
            engines.Decoder().pages(ok)
    place = lambda p, box=(0.0, 50.0, 100.0, 0.0): [(p, *box)]
    items = [
        (1, 1, "DocItemLabel.SECTION_HEADER", " Head ", place(1), 2, 1, None, None, None, None, None, None, None, None), (1, 2, "text", "  ", place(1), None, 1, None, None, None, None, None, None, None, None), (1, 3, "list_item", "it", place(1), None, 4, True, "2.", None, None, None, None, None, None),
        (1, 4, "code", "\n  x = 1\n", place(1), None, 1, None, None, "Python", None, None, None, None, None), (1, 5, "table", "", place(1), None, 1, None, None, None, 2, 1, [(1, 1)], "<table></table>", "| a |\n|---|\n| b |"), (1, 6, "table", "", place(1), None, 1, None, None, None, 2, 1, [(2, 1)], "<table></table>", "x"),
        (1, 7, "picture", "", place(1, (0.0, 10.0, 10.0, 0.0)), None, 1, None, None, None, None, None, None, None, None), (1, 8, "odd", "nowhere", place(0), None, 1, None, None, None, None, None, None, None, None), (1, 9, "odd", "para", place(2), None, 1, None, None, None, None, None, None, None, None),
    ]
    schema = "doc_id long, nth int, label string, text string, prov array<struct<page_no:int,l:double,t:double,r:double,b:double>>, level int, tree_level int, enumerated boolean, marker string, code_language string, num_rows int, num_cols int, cells array<struct<row_span:int,col_span:int>>, html string, markdown string"
    got = engines.items_to_blocks(spark.createDataFrame(items, schema)).orderBy("page", "seq").collect()
    assert [(r.block_id, r.type, r.text, r.level, r.table_html) for r in got] == [
        ("p1-docling-1", "heading", "Head", 3, None), ("p1-docling-3", "list_item", "it", None, None), ("p1-docling-4", "code", "  x = 1", None, None), ("p1-docling-5", "table", "| a |\n|---|\n| b |", None, None),
        ("p1-docling-6", "table", "", None, "<table></table>"), ("p1-docling-7", "image", "第 1 页图片", None, None), ("p2-docling-1", "paragraph", "para", None, None),
    ]
    assert (got[1].meta.ordered, got[1].meta.marker, got[1].meta.indent_level, got[2].meta.language) == (True, "2.", 2, "python") and got[5].asset_path is None


def test_sinks(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "m1"), (2, "m2")], "doc_id long, markdown string")
    for _ in range(2):
        sinks.write(str(tmp_path / "out"), docs, docs, docs, docs)
    sinks.write(str(tmp_path / "out"), docs.where("doc_id = 2").selectExpr("doc_id", "'new' as markdown"), docs, docs, docs)
    got = spark.read.json(str(tmp_path / "out" / "document.md")).select("doc_id", "markdown").collect()
    assert sorted(map(tuple, got)) == [(1, "m1"), (2, "new")]
    monkeypatch.setattr(sinks, "BUCKETS", 1)  # documents that share a bucket
    both = str(tmp_path / "shared")
    sinks.write(both, docs, docs, docs, docs)
    sinks.write(both, *[docs.where("doc_id = 2").selectExpr("doc_id", "'new' as markdown")] * 4)
    assert [readers.result(spark, both, "document.md", k).first().markdown for k in (1, 2)] == ["m1", "new"]
    assert spark.read.json(f"{both}/document.json").count() == 2
    monkeypatch.undo()
    sinks.zip_results(spark, str(tmp_path / "out"), [2, 1], str(tmp_path / "r.zip"))
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip") as bundle:
        assert bundle.read("results/01-2/document.md") == b"new" and len(bundle.namelist()) == 8
    ids = [f"{k:032x}" for k in range(3)]
    jobs = spark.createDataFrame([(i, "completed") for i in ids], "id string, status string")
    asked = lambda names: spark.createDataFrame(list(enumerate(names)), "nth int, id string")
    sizes = spark.createDataFrame([(i, 10) for i in ids], "id string, size long")
    why = lambda names, **o: sinks.archive_problem(asked(names), jobs, sizes, **o).first().reason
    assert why(ids) is None and why(ids[:1] * 2) == "duplicates" and why(["x"]) == "bad_id" and why(["f" * 32]) == "not_completed" and why(ids, max_files=2) == "too_many" and why(ids, max_bytes=20) == "too_large"
