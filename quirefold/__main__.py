"""python -m quirefold INPUT OUTPUT: convert text files (pages end with a form feed) to Markdown with a quality report.

Exit code 0: every document passed; 2: some did not; 1: an error.
"""

from __future__ import annotations

import argparse
import sys

from . import __version__, schema


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirefold", description=__doc__)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--engine", default="native")
    p.add_argument("--fallback-engine", default="native")
    p.add_argument("--page-markers", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--front-matter", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--no-quality-fallback", action="store_true")
    p.add_argument("--minimum-quality-score", type=float, default=schema.MINIMUM_SCORE)
    p.add_argument("--engine-status", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .plans import convert
    from .sources import engines, readers, sinks

    spark = SparkSession.builder.appName("quirefold").getOrCreate()
    if args.engine_status:
        engines.statuses(spark).show(truncate=False)
        return 0
    if not args.input or not args.output:
        parser().error("INPUT and OUTPUT are needed")
    try:
        documents, pages, facts = readers.text_files(spark, args.input)
        options = convert.Options(args.engine, args.fallback_engine, not args.no_quality_fallback, args.minimum_quality_score, args.front_matter, args.page_markers)
        made = convert.convert(documents, pages, facts, options)
        sinks.write(args.output, made.markdown, made.blocks, made.report.documents, made.manifest)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0 if made.report.documents.where("not passed").isEmpty() else 2


if __name__ == "__main__":
    sys.exit(main())
