"""The command line over text files."""

from quirefold import __main__ as cli
from quirefold.sources import readers


def test_convert_text_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Report\n\n" + "This is a long line of ordinary prose about nothing at all. " * 3 + "\fSecond page\n\n- one\n- two")
    out = str(tmp_path / "out")
    assert cli.main([str(folder), out, "--page-markers"]) == 0
    report = readers.reports(spark, out).first()
    assert report.passed and report.page_count == 2 and report.score == 88
    markdown = readers.result(spark, out, "document.md", report.doc_id).first().markdown
    assert markdown.startswith('---\ntitle: "a"\n') and "<!-- page: 2 -->\n## Second page\n\n- one\n- two\n" in markdown
    assert cli.main([str(folder), out, "--minimum-quality-score", "95"]) == 2
    assert cli.main([str(tmp_path / "none"), out]) == 1
    assert cli.main(["--engine-status"]) == 0
