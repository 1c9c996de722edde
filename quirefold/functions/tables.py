"""Pipe tables and HTML tables, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, newlines, strip

#: Stand-ins for an escaped character's backslash and pipe while a row is split.
_MARK = "\ue000"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(newlines(text), "\n", -1), strip), lambda x: x != "")


def split_row(line: Column) -> Column:
    """Cells of one row; a backslash keeps the next character in its cell. Null without a pipe."""
    guarded = F.when(F.contains(line, F.lit("\\\\")), _guard_pairs(line)).otherwise(F.regexp_replace(line, r"\\\|", f"\\\\{_MARK}"))
    cells = F.transform(F.split(guarded, r"\|", -1), lambda x: strip(F.replace(x, F.lit(_MARK), F.lit("|"))))

    def trimmed(c: Column) -> Column:
        first = F.when(F.get(c, F.lit(0)) == "", 2).otherwise(1)
        last = F.when((F.size(c) > 1) & (F.element_at(c, -1) == ""), F.size(c) - 1).otherwise(F.size(c))
        return F.slice(c, first, F.greatest(F.lit(0), last - first + 1))

    return F.when(F.contains(line, F.lit("|")), let(let(cells, trimmed), lambda c: F.when(F.size(c) > 0, c)))


def _guard_pairs(line: Column) -> Column:
    """With doubled backslashes, pairs are consumed from the left."""
    return F.regexp_replace(line, r"\G((?:[^\\]|\\[^|])*?)\\\|", f"$1\\\\{_MARK}")


def rows(text: Column) -> Column:
    """Cells of every row, separator included; null if a line is no row or there is none."""
    return let(F.transform(lines(text), split_row), lambda found: F.when((F.size(found) > 0) & F.forall(found, lambda r: r.isNotNull()), found))


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))


def shape(text: Column) -> Column:
    """struct(rows, columns, separator_index): content rows, cells of each row, index of the separator."""

    def of(every: Column) -> Column:
        where = F.array_position(F.transform(every, is_separator), True)
        return let(where, lambda w: F.struct(F.when(w > 0, F.size(every) - 1).otherwise(F.size(every)).alias("rows"), F.transform(every, F.size).alias("columns"), F.when(w > 0, (w - 1).cast("int")).alias("separator_index")))

    return let(F.coalesce(rows(text), F.array().cast("array<array<string>>")), of)


def is_valid(found: Column, expected_rows: Column | None = None, expected_columns: Column | None = None) -> Column:
    """Of a shape: separator second, a content row, equal widths; and the expected size where it is known."""

    def check(s: Column) -> Column:
        width = F.array_max(s["columns"])
        ok = (s["rows"] >= 1) & (F.coalesce(s["separator_index"], F.lit(-1)) == 1) & (F.size(s["columns"]) > 0) & (F.array_min(s["columns"]) == width) & (width > 0)
        if expected_rows is not None:
            ok = ok & F.coalesce(s["rows"] == expected_rows, F.lit(True))
        if expected_columns is not None:
            ok = ok & F.coalesce(width == expected_columns, F.lit(True))
        return F.coalesce(ok, F.lit(False))

    return let(found, check)


def render(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, strip), " | "), F.lit(" |"))), "\n")


def html_columns(html: Column) -> Column:
    """For each row of an HTML table, the sum of its cells' column spans."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))

    def width(row: Column) -> Column:
        tags = F.regexp_extract_all(row, F.lit(r"(?i)<t[dh]\b[^>]*>"), F.lit(0))
        spans = F.transform(tags, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\bcolspan=[\"']?(\d+)", 1), F.lit("")).cast("int"), F.lit(1)))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    return F.transform(found, width)


def mismatch(text: Column, html: Column, expected_rows: Column, expected_columns: Column) -> Column:
    """Whether a table block's text or HTML differs from the shape that its metadata state, or has none."""

    def differs(widths: Column) -> Column:
        return (
            F.coalesce(F.size(widths) != expected_rows, F.lit(False))
            | F.coalesce(F.exists(widths, lambda w: w != expected_columns), F.lit(False))
            | (~F.contains(F.lower(html), F.lit("rowspan=")) & (F.size(F.array_distinct(widths)) > 1))
        )

    by_html = let(html_columns(html), differs)
    by_text = (F.coalesce(text, F.lit("")) != "") & ~is_valid(shape(F.coalesce(text, F.lit(""))), expected_rows, expected_columns)
    return F.when(F.coalesce(html, F.lit("")) != "", by_html).otherwise(by_text)
