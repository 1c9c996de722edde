"""The quality gate on small inputs: codes, severities and scores."""

import pytest
from helpers import blocks, inspections

from quirefold.operators import quality


def gate(spark, rows, pages, **options):
    r = quality.evaluate(inspections(spark, pages), blocks(spark, rows), **options)
    return {p.page: p for p in r.pages.collect()}, sorted((i.code, i.severity, i.page) for i in r.issues.collect()), r.documents.first()


def text(n, start=0):
    return " ".join(f"w{start + k:03d}" for k in range(n))


def test_complete_text_passes(spark):
    pages, issues, doc = gate(spark, [{"type": "paragraph", "text": "a" * 110}], {1: 100})
    assert pages[1].score == 100 and not issues and doc.passed and not pages[1].needs_fallback


def test_empty_and_missing_pages(spark):
    pages, issues, doc = gate(spark, [{"type": "paragraph", "text": " "}], {1: 100, 2: 100, 3: 0})
    assert ("empty_output", "error", 1) in issues and ("missing_page", "error", 2) in issues
    assert pages[1].score == 30 and pages[2].score == 0 and not doc.passed
    assert doc.fallback_pages == [1, 2] and not pages[3].needs_fallback


def test_duplicates(spark):
    pages, issues, _ = gate(spark, [{"type": "paragraph", "text": t} for t in ["Same  text"] * 3 + [" same TEXT", "same text"]], {1: 40})
    assert issues == [("duplicate_content", "warning", 1)] and pages[1].duplicate_ratio > 0.5 and pages[1].score == 85


def test_garble_and_control(spark):
    pages, issues, doc = gate(spark, [{"type": "paragraph", "text": "a" * 100 + "\ufffd" * 10 + "\x01\x02b"}], {1: 113})
    assert [i[0] for i in issues] == ["control_characters", "garbled_text"] and not doc.passed
    # the control characters U+0001 and U+0002 are no white space, so they count as characters
    assert pages[1].score == pytest.approx(100 - 200 * 10 / 113 - 200 * 2 / 113, abs=0.01)


@pytest.mark.parametrize("chars, code, score", [(30, "low_text_coverage", 70), (50, "reduced_text_coverage", 88), (170, "excess_text_coverage", 85), (210, "excess_text_coverage", 70)])
def test_coverage(spark, chars, code, score):
    pages, issues, _ = gate(spark, [{"type": "paragraph", "text": "a" * chars}], {1: 100})
    assert [i[0] for i in issues] == [code] and pages[1].score == score


def test_structured_table_explains_expansion(spark):
    table = "| a | b |\n|---|---|\n" + f"| {'x' * 120} | {'y' * 120} |"
    pages, issues, doc = gate(spark, [{"type": "table", "text": table, "meta": {"table_rows": 2, "table_columns": 2}}], {1: 100})
    assert issues == [("excess_text_coverage", "warning", 1)] and pages[1].score == 85 and not pages[1].needs_fallback and doc.passed


def test_code_layout(spark):
    collapsed = "import os from sys import path def main(x): return [y for y in x if y] value = main(path) print(value)"
    rows = [{"type": "code", "text": collapsed}, {"type": "code", "text": collapsed + " 1 2 3 4"}, {"type": "code", "text": ");"}, {"type": "code", "text": "]"}]
    _, issues, _ = gate(spark, rows, {1: 180}, with_code=True)
    codes = [i[0] for i in issues if i[0] != "python_syntax_error"]
    assert codes == ["collapsed_code_layout", "line_number_contamination", "orphan_code_fragment"]
    assert ("orphan_code_fragment", "error", 1) in issues


def test_flat_headings(spark):
    rows = [{"type": "heading", "level": 2, "text": f"1.{k} Part"} for k in range(8)] + [{"type": "paragraph", "text": text(100)}]
    pages, issues, _ = gate(spark, rows, {1: 100})
    assert [i[0] for i in issues].count("flat_heading_hierarchy") == 1 and ("excess_text_coverage", "error", 1) in issues
    assert pages[1].needs_fallback and pages[1].score == 45


def test_native_cap(spark):
    pages, issues, doc = gate(spark, [{"type": "paragraph", "text": "a" * 100}], {1: 100}, engine="native")
    assert pages[1].score == 88 and issues == [("limited_layout_validation", "info", None)] and doc.passed and doc.info_count == 1


def test_document_score_blends_the_lowest_tenth(spark):
    rows = [{"type": "paragraph", "text": "a" * 100, "page": p} for p in range(1, 11)]
    rows[4]["text"] = "a" * 30
    _, _, doc = gate(spark, rows, {p: 100 for p in range(1, 11)})
    assert doc.score == pytest.approx(0.8 * 97 + 0.2 * 70) and doc.mean_page_score == 97 and doc.low_decile_score == 70


def test_assets(spark):
    rows = [{"type": "image", "asset_path": p, "block_id": p, "box": b} for p, b in (("assets/a.png", (0, 10, 10, 0)), ("assets/none.png", None), ("../x.png", None), ("assets/b.png", None))]
    files = spark.createDataFrame([(1, "assets/a.png", 500.0, 500.0), (1, "../x.png", 5.0, 5.0), (1, "assets/b.png", 20.0, 20.0)], "doc_id long, path string, width double, height double")
    pages, issues, _ = gate(spark, [*rows, {"type": "paragraph", "text": "a" * 60}, {"type": "table", "block_id": "t"}], {1: 60}, assets=files)
    assert [i[0] for i in issues] == ["empty_table", "missing_asset", "missing_asset", "tiny_asset"]
    assert pages[1].score == 100 - 15 - 20 - 10


def test_logical_code_over_pages(spark):
    first = "def f(x):\n    y = [\n        1,"
    rows = [
        {"type": "code", "text": first, "page": 1, "meta": {"language": "python"}},
        {"type": "code", "text": "        2,\n    ]\n    return y", "page": 2, "meta": {"language": "python", "continues_previous": True}},
        {"type": "code", "text": "def g(:", "page": 2, "meta": {"language": "python"}},
    ]
    found = quality.code_findings(blocks(spark, rows)).orderBy("grp").collect()
    assert [(r.code, r.is_error) for r in found] == [(None, False), ("python_syntax_error", False)]
    m = quality.code_metrics(quality.code_findings(blocks(spark, rows))).first()
    assert (m.logical_code_block_count, m.checked_code_block_count, m.invalid_code_block_count, m.code_quality_score) == (2, 2, 1, 50)


def test_raw_fences(spark):
    raw = "text\n```python\ndef f(:\n```\n\n~~~~\nplain\n~~~\nmore\n~~~~\n```json\n{\"a\": 1,}\n```\n```python\nx = 1"
    rows = [{"type": "raw_markdown", "text": raw, "block_id": "r"}]
    assert quality.scan_fences(raw) == [("python", "def f(:", False), ("", "plain\n~~~\nmore", False), ("json", '{"a": 1,}', False), ("python", "x = 1", True)]
    found = {r.grp: r for r in quality.code_findings(blocks(spark, rows)).collect()}
    assert [found[k].code for k in sorted(found)] == ["python_syntax_error", None, "json_syntax_error", "unclosed_code_fence"]
    assert all(found[k].is_error for k in (1, 3, 4)) and found[4].deduction == 25


def test_error_line_names_its_page(spark):
    rows = [{"type": "code", "text": "\n".join(f"a{k} = {k}" for k in range(6)), "page": 1, "meta": {"language": "python"}}, {"type": "code", "text": "b = 1\nc = = 2\nimport d", "page": 2, "meta": {"continues_previous": True}}]
    r = quality.code_findings(blocks(spark, rows)).first()
    assert r.code == "python_syntax_error" and r.page == 2 and r.is_error and r.line == 8


def test_image_recovery_flags(spark):
    sure = {"image_layout_recovered": True, "image_layout_confidence": 0.95, "image_layout_similarity": 0.92}
    pages, issues, _ = gate(spark, [{"type": "code", "text": "x" * 200, "meta": sure}], {1: 100})
    assert [i[:2] for i in issues] == [("image_ocr_review_required", "warning"), ("recovered_image_text_expansion", "info")] and pages[1].score == 100
    pages, issues, _ = gate(spark, [{"type": "code", "text": "x" * 100, "meta": {**sure, "image_layout_similarity": 0.7}}], {1: 100})
    assert pages[1].score == 95
