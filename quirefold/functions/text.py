"""Text columns. White space is Unicode white space and U+001C to U+001F."""

from __future__ import annotations

from collections.abc import Callable

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1C-\x1F]"
CJK = "\u3400-\u9fff"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value bound once: a column that f uses often is neither planned nor computed often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def compact(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{WS}+", "")


def _table(entries: dict[str, str]) -> Column:
    """A constant map."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in entries.items())), F.lit("\x02"), F.lit("\x01"))


#: Characters whose case folding is not their lower case, with it; by the tables of Unicode.
FOLDED = {c: f for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (f := c.casefold()) != c.lower()}


def _ranges(chars: set[str]) -> str:
    """The inside of a character class, as ranges: Java tries the members of a class one after the other."""
    points, ranges = sorted(map(ord, chars)), []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def fold(c: Column) -> Column:
    """Case folding: lower case, but for the characters of FOLDED; only texts that hold one are gone through."""
    table = {x.lower(): f for x, f in FOLDED.items() if len(x.lower()) == 1}
    rare = _ranges({*table, "ς"})
    low = F.lower(c)
    pieces = F.regexp_extract_all(low, F.lit(f"[^{rare}]+|[{rare}]"), F.lit(0))
    folded = F.array_join(F.transform(pieces, lambda x: F.when(F.length(x) == 1, F.coalesce(F.try_element_at(_table(table), x), x)).otherwise(x)), "")
    return F.when(c.rlike("[^\\x00-\\x7f]") & low.rlike(f"[{rare}]"), folded).otherwise(low)


def normal(c: Column) -> Column:
    return fold(squeeze(c))


def newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def close_cjk(c: Column) -> Column:
    """Spaces between two CJK characters go."""
    return F.regexp_replace(c, f"(?<=[{CJK}]) +(?=[{CJK}])", "")


def clean(c: Column) -> Column:
    """For prose output: no NUL, single spaces, no empty lines, no space inside CJK."""
    lines = F.transform(F.split(newlines(F.replace(c, F.lit("\0"), F.lit(""))), "\n", -1), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return close_cjk(strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n")))


def clean_code(c: Column) -> Column:
    """For code output: no NUL or no-break space, no trailing blanks, no blank edge lines."""
    text = F.replace(newlines(F.replace(c, F.lit("\0"), F.lit(""))), F.lit("\u00a0"), F.lit(" "))
    lines = F.array_join(F.transform(F.split(text, "\n", -1), rstrip), "\n")
    return F.regexp_replace(lines, r"^\n+|\n+\z", "")


def single_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(squeeze(c), "^#+", ""))


# Entities that most texts make do with.
COMMON_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("middot", "·"), ("copy", "©"), ("nbsp", "\u00a0"), ("amp", "&"))
#: Names that also resolve without a semicolon, longest first.
_LOOSE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


#: Spaces of Unicode, without tabs and line ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def html_visible(c: Column, blanks: str = WS, common_only: bool = False) -> Column:
    """Visible text of HTML: tags become spaces, blanks squeeze, entities resolve once, ampersand last.

    Texts with other than the common entities are resolved piece by piece, by the names of HTML 5,
    unless `common_only` leaves the others as they are. `blanks` is the pattern of a blank.
    """

    def resolved(t: Column) -> Column:
        common = t
        for name, char in COMMON_ENTITIES:
            common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
        if common_only:
            return common
        rare = t.rlike(f"&(?!(?:{'|'.join(n for n, _ in COMMON_ENTITIES)});)[#A-Za-z]")
        pieces = F.regexp_extract_all(t, F.lit(f"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z0-9]+;|&(?:{_LOOSE})|[^&]+|&"), F.lit(0))
        return F.when(rare, F.array_join(F.transform(pieces, _entity), "")).otherwise(common)

    return let(F.btrim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), f"{blanks}+", " "), F.lit(SPACES)), resolved)


def _entity(piece: Column) -> Column:
    """The characters of a reference; any other piece as it is."""
    names = _table(html5)
    name = F.substr(piece, F.lit(2))
    loose = F.regexp_extract(name, f"^(?:{_LOOSE})", 0)
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(piece, "^&#0*([0-9]{1,9});?$", 1), F.lit("")), F.lit("999999999")).cast("long"), F.conv(F.nullif(F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1), F.lit("")), 16, 10).cast("long"))
    # numbers of the C1 block stand for the characters of code page 1252
    old = _table({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})
    bad = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    none = number.between(1, 8) | number.isin(0xB, 0x7F) | number.between(0xE, 0x1F) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    point = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    zero = piece.rlike("^&#(?:0+|[xX]0+);?$")
    is_number = piece.rlike("^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?$")
    numeric = F.when(zero | number.isNull() | bad, "\ufffd").when(F.try_element_at(old, number.cast("string")).isNotNull(), F.try_element_at(old, number.cast("string"))).when(none, "").otherwise(point)
    named = F.coalesce(F.try_element_at(names, name), F.when(loose != "", F.concat(F.try_element_at(names, loose), F.substr(name, F.length(loose) + 1))), piece)
    return F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece).when(is_number, numeric).otherwise(named)


def join_wrapped(lines: Column) -> Column:
    """Join wrapped lines: a hyphen before lower case goes, CJK meets without a space."""

    def merge(acc: Column, line: Column) -> Column:
        hyphen = acc.rlike("[A-Za-z]-$") & line.rlike("^[a-z]")
        cjk = acc.rlike(f"[{CJK}]$") & line.rlike(f"^[{CJK}]")
        return F.when(acc.isNull(), line).when(hyphen, F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), line)).when(cjk, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return F.aggregate(lines, F.lit(None).cast("string"), merge)


# Signs that join to the left, and signs that what follows joins to.
CLOSERS, OPENERS = "，。；：！？、,.!?;:)]}）】》", "([{（【《"


def join_fragments(first: Column, second: Column) -> Column:
    """Two fragments of a line with punctuation-aware spacing."""
    a, b = rstrip(first), F.regexp_replace(second, f"^{WS}+", "")
    tight = F.instr(F.lit(CLOSERS), F.left(b, F.lit(1))) > 0
    tight = tight | (F.instr(F.lit(OPENERS), F.right(a, F.lit(1))) > 0)
    return F.when(a == "", b).when(b == "", a).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def clean_metadata(c: Column) -> Column:
    """Trimmed, without NUL; empty becomes null."""
    return F.nullif(F.trim(strip(F.replace(c, F.lit("\0"), F.lit("")))), F.lit(""))


def safe_filename(c: Column, default: str = "document.pdf") -> Column:
    """The last part of a path with either separator, without NUL, at most 200 characters."""
    name = F.regexp_extract(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/+\z", ""), r"([^/]*)\z", 1)
    name = strip(F.replace(name, F.lit("\0"), F.lit("")))
    return F.coalesce(F.nullif(F.left(name, F.lit(200)), F.lit("")), F.lit(default))


def safe_fence(c: Column) -> Column:
    """A backtick fence longer than any run of backticks in the text; three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def yaml_string(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit('"'), out, F.lit('"'))


def settle_spacing(c: Column) -> Column:
    """Four or more newlines become three; exactly one ends the text."""
    return F.concat(strip(F.regexp_replace(c, "\n{4,}", "\n\n\n")), F.lit("\n"))
