"""Tables of the document model, their columns, and every threshold in one place.

Blocks are ordered by (doc_id, page, seq); boxes have their origin at the bottom left.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Block types, and those that count as text.
BLOCK_TYPES = ["title", "heading", "paragraph", "list_item", "table", "formula", "code", "image", "caption", "footnote", "page_header", "page_footer", "raw_markdown"]
TEXT_TYPES = ["title", "heading", "paragraph", "list_item", "table", "formula", "code", "caption", "footnote", "raw_markdown"]
DOCUMENT_KINDS = ["born_digital", "scanned", "mixed", "unknown"]
OCR_MODES = ["auto", "always", "never"]
JOB_STATES = ["queued", "running", "completed", "failed"]
SEVERITIES = ["info", "warning", "error"]
ENGINES = ["native", "docling", "paddle"]

# Thresholds.
MINIMUM_SCORE = 72.0
NATIVE_CAP = 88.0
MEAN_WEIGHT, LOW_WEIGHT, LOW_SHARE = 0.8, 0.2, 0.1
DUPLICATE_RATIO = 0.2
COVERAGE_FROM = 50
COVERAGE_LOW, COVERAGE_REDUCED, COVERAGE_HIGH, COVERAGE_EXCESS = 0.35, 0.65, 1.6, 2.0
GARBLED_RATIO, CONTROL_RATIO, RATIO_SLOPE, GARBLED_CAP, CONTROL_CAP = 0.01, 0.005, 200.0, 35.0, 20.0
FINDING_CAP = 45.0
SYNTAX_ERROR_LINES = 8
FLAT_HEADINGS, FLAT_DOMINANT, FLAT_LEVELS, FLAT_MISMATCHES = 8, 0.9, 2, 4
PAGE_TEXT_CHARS, SCANNED_SHARE, MAX_PAGE_SIDE = 20, 0.8, 20_000.0
TINY_ASSET = 24.0
MAX_FILE_BYTES, MAX_PAGES, MAX_BATCH_FILES, MAX_ARCHIVE_BYTES = 200 << 20, 500, 20, 512 << 20

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("left", "top", "right", "bottom")])

META = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("language_source", T.StringType()),
        T.StructField("code_kind", T.StringType()),
        T.StructField("continues_previous", T.BooleanType()),
        T.StructField("layout_recovered", T.BooleanType()),
        T.StructField("layout_source", T.StringType()),
        T.StructField("layout_confidence", T.DoubleType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("source_start", T.IntegerType()),
        T.StructField("source_end", T.IntegerType()),
        T.StructField("image_layout_recovered", T.BooleanType()),
        T.StructField("image_layout_confidence", T.DoubleType()),
        T.StructField("image_layout_similarity", T.DoubleType()),
        T.StructField("table_rows", T.IntegerType()),
        T.StructField("table_columns", T.IntegerType()),
        T.StructField("has_spans", T.BooleanType()),
        T.StructField("table_alignment_repaired", T.BooleanType()),
        T.StructField("table_alignment_repaired_rows", T.ArrayType(T.StringType())),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("marker", T.StringType()),
        T.StructField("indent_level", T.IntegerType()),
        T.StructField("semantic_level", T.IntegerType()),
        T.StructField("continued_pages", T.ArrayType(T.IntegerType())),
        T.StructField("continuation_noise_removed", T.IntegerType()),
        T.StructField("merged_block_ids", T.ArrayType(T.StringType())),
        T.StructField("merged_heading_label", T.BooleanType()),
        T.StructField("promoted_from_paragraph", T.BooleanType()),
        T.StructField("promoted_from_caption", T.BooleanType()),
        T.StructField("duplicate_removed", T.BooleanType()),
        T.StructField("demoted_after_layout_recovery", T.BooleanType()),
        T.StructField("layout_table_recovered", T.BooleanType()),
    ]
)

BLOCKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("block_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("level", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("engine", T.StringType()),
        T.StructField("asset_path", T.StringType()),
        T.StructField("table_html", T.StringType()),
        T.StructField("meta", META),
    ]
)

PAGE_INSPECTIONS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("rotation", T.IntegerType()),
        T.StructField("native_text_chars", T.LongType()),
        T.StructField("image_count", T.IntegerType()),
        T.StructField("is_blank", T.BooleanType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("stage", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("options_json", T.StringType()),
    ]
)
