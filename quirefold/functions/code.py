"""Code columns: languages, kinds, signals and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, let, strip

U = "(?U)"
# Names that stand for another language.
ALIASES = {"py": "python", "python3": "python", "application/json": "json", "json5": "json"}
# Patterns of the language rules, in their order.
JS_WORDS = r"\b(?:const|let|function|interface|export|console\.log)\b"
TYPESCRIPT = r"\binterface\b|:\s*[A-Z][A-Za-z]+"
PYTHON_SIGNALS = [
    r"\b(?:async|await|class|def|elif|except|from|import|lambda|print|raise|return|try|while|with|yield)\b",
    r"(?m)^\s*@\w+",
    r"\.(?:invoke|from_messages)\s*\(",
    r"(?m)^\s*[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)?\s*=\s*(?:[\"'\[{]|[A-Za-z_]\w*\.|\w+\()",
    r"(?m)^\s*#(?!#|\s)",
]
PYTHON_LINE = r"(?m)^\s*(?:from|import|class|def|async\s+def)\b"
JSON_KEY = r'"[^"\n]+"\s*:'
SQL = r"\b(?:select|insert\s+into|update|delete\s+from|create\s+table)\b"
BASH = r"(?m)^\s*(?:#!/|\$\s)|\b(?:echo|fi|done|export)\b"
JAVA = r"\b(?:public\s+class|private\s+static|System\.out\.println)\b"
CPP = r"#include\s*<|\bstd::|\b(?:int|void)\s+main\s*\("
OUTPUT_NAME = r"^(?:AIMessage|HumanMessage|SystemMessage|ToolMessage|ChatPromptValue)\s*\("
OUTPUT_FIELD = r"\b(?:content|additional_kwargs|response_metadata|usage_metadata)\s*="
BLOB_SIGNAL = r"\b(?:class|def|elif|else|for|from|if|import|print|return|try|while|with)\b|(?:==|!=|<=|>=|=>|->|:=|[(){}\[\]=;])"
CODE_LINE = r"^(?:print\s*\(|return(?:\s|$)|raise(?:\s|$)|import\s+\w|from\s+\S+\s+import\s+\w|(?:async\s+)?def\s+\w+\s*\(|class\s+\w+|if\s+.+:|for\s+.+:|while\s+.+:)"
STATEMENT_SIGNAL = r"\b(?:class|def|elif|else|except|for|from|if|import|print|return|try|while|with)\b|(?<![=!<>])=(?!=)"
NUMBER_TAIL = r"(?<!\S)(\d+(?:[ \t]+\d+){3,})\s*$"
ORPHAN = r"^[~'\"`()\[\]{}.,;:]+$"


def _rx(pattern: str) -> str:
    return U + pattern


def language_name(c: Column) -> Column:
    name = fold(strip(c))
    out = name
    for alias, real in ALIASES.items():
        out = F.when(name == alias, real).otherwise(out)
    return out


def infer_language(text: Column) -> Column:
    """The first language whose signals are strong enough; empty if none."""
    return let(fold(text), lambda low: _inferred(text, low))


def _inferred(text: Column, low: Column) -> Column:
    signals = [(low if not k else text).rlike(_rx(p)) for k, p in enumerate(PYTHON_SIGNALS)]
    strength = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    head = F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+", "")
    return (
        F.when(low.rlike(_rx(JS_WORDS)), F.when(text.rlike(_rx(TYPESCRIPT)), "typescript").otherwise("javascript"))
        .when((strength >= 2) | (signals[0] & text.rlike(_rx(PYTHON_LINE))), "python")
        .when((F.startswith(head, F.lit("{")) | F.startswith(head, F.lit("["))) & text.rlike(_rx(JSON_KEY)), "json")
        .when(low.rlike(_rx(SQL)), "sql")
        .when(text.rlike(_rx(BASH)), "bash")
        .when(text.rlike(_rx(JAVA)), "java")
        .when(text.rlike(_rx(CPP)), "cpp")
        .otherwise("")
    )


def resolve_language(text: Column, candidates: Column) -> Column:
    """`candidates`: array of (language, source). The structured engine's word first, then inference, then any word."""
    named = F.filter(F.transform(candidates, lambda c: F.struct(language_name(F.coalesce(c["language"], F.lit(""))).alias("language"), fold(strip(F.coalesce(c["source"], F.lit("")))).alias("source"))), lambda c: c["language"] != "")
    trusted = F.get(F.filter(named, lambda c: c["source"] == "docling"), F.lit(0))["language"]
    return F.coalesce(trusted, F.nullif(infer_language(text), F.lit("")), F.get(named, F.lit(0))["language"], F.lit(""))


def code_kind(text: Column) -> Column:
    """`output` for printed message objects, otherwise empty."""
    head = F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+", "")
    return F.when(head.rlike(_rx(OUTPUT_NAME)) & head.rlike(_rx(OUTPUT_FIELD)), "output").otherwise("")


def is_code_blob(text: Column) -> Column:
    return (F.length(text) >= 100) & (F.regexp_count(text, F.lit(_rx(BLOB_SIGNAL))) >= 4)


def is_code_line(text: Column) -> Column:
    return text.rlike(_rx(CODE_LINE))


def statement_signals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_rx(STATEMENT_SIGNAL)))


def has_number_tail(text: Column) -> Column:
    """A tail of four or more integers, each one more than the last."""
    tail = F.regexp_extract(text, _rx(NUMBER_TAIL), 1)
    numbers = F.transform(F.filter(F.split(tail, "[ \t]+"), lambda x: x != ""), lambda x: x.cast("decimal(38,0)"))
    n = F.size(numbers)
    steps = F.zip_with(F.slice(numbers, 1, F.greatest(n - 1, F.lit(0))), F.slice(numbers, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b == a + 1)
    return (tail != "") & F.forall(steps, lambda x: x)


def is_orphan(text: Column) -> Column:
    """One to four characters, all of them signs that never stand alone."""
    short = strip(text)
    return (F.length(short).between(1, 4)) & short.rlike(ORPHAN)


# What counts as a sign of code in a layout line.
LAYOUT_KEYWORDS = r"(?i)\b(?:async|await|class|const|def|elif|else|except|export|finally|for|from|function|if|import|interface|lambda|let|npm|package|pip|print|python|raise|return|select|try|var|while|with|yield)\b"
LAYOUT_PUNCTUATION = r"(?:==|!=|<=|>=|=>|->|:=|\+=|-=|\*=|/=|[(){}\[\]=:_`;])"


def confidence(lines: Column) -> Column:
    """0.15 plus shares for keywords, signs, lines with either, and indented lines; 0 without a line."""
    some = F.filter(lines, lambda x: strip(x) != "")
    n = F.size(some)
    joined = F.array_join(some, "\n")
    indented = F.size(F.filter(some, lambda x: x.rlike(r"(?U)^[\s\x1C-\x1F]")))
    coded = F.size(F.filter(some, lambda x: x.rlike(_rx(LAYOUT_KEYWORDS)) | x.rlike(LAYOUT_PUNCTUATION)))
    score = (
        F.lit(0.15)
        + F.least(F.lit(0.25), F.regexp_count(joined, F.lit(_rx(LAYOUT_KEYWORDS))) * 0.08)
        + F.least(F.lit(0.3), F.regexp_count(joined, F.lit(LAYOUT_PUNCTUATION)) * 0.03)
        + F.least(F.lit(0.25), coded / F.greatest(n, F.lit(1)) * 0.25)
        + F.least(F.lit(0.1), indented / F.greatest(n, F.lit(1)) * 0.15)
    )
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), score))
