"""Quality by weak supervision, in DataFrame functions only.

Ten rules look at counts of a document and vote good, bad or abstain. How often each
rule is right where it votes, and the share of good documents, are estimated by
expectation-maximisation on the table of vote patterns, which one aggregation brings to
the driver: at most 3^10 rows, whatever the size of the corpus, with the number of
documents of each. A document is
good if its posterior probability, by its votes and those estimates, is one half or
more. No labels are read. Counts of the whole text are made once and checkpointed; they
hold a few numbers a document.

Words are runs of characters other than U+0020 and U+0009 to U+000D. Windows of eight
words are compared by 64-bit hashes of their words' hashes, in arrays: a window's hashes
are sorted only in documents that repeat one.

Defined results: a null text has no words and counts of 0; it fails the base rule.
Repeated rows give repeated results. Without any document there is nothing to estimate
and the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the languages that the rule on them knows.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "that", "is", "with", "der", "die", "und", "das", "ein", "nicht", "von", "le", "la", "les", "de", "et", "que", "un", "une", "des", "el", "los", "y", "en", "por", "con"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_adjacent", "n_function", "n_ended"]
RULES = ["length", "symbols", "dup_lines", "repeats", "word_length", "function_words", "adjacent", "distinct", "line_ends", "shouting"]


def _at(array: str, index: Column) -> Column:
    return F.get(F.col(array), index)


def counts(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """`docs` without other columns than it has, plus COUNTS and n_upper (long).

    Each step reads arrays of the step before more than once, which keeps the optimizer
    from folding an array's computation into the lambda that reads its elements.
    """
    text = F.coalesce(F.col("_q_text"), F.lit(""))
    out = docs.withColumn("_q_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_q_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("_q_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    keep = docs.columns
    n_chars = F.char_length(text)
    out = out.select(
        *keep,
        F.size("_q_words").cast("long").alias("n_words"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (n_chars - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_q_lines", lambda x: x.rlike(r"[.!?:;»”\"')]\s*$"))).cast("long").alias("n_ended"),
        F.size(F.filter("_q_words", lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        (n_chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        F.transform("_q_words", lambda x: F.xxhash64(x)).alias("_q_h"),
    )
    n = F.size("_q_h")
    made = [*keep, *(c for c in out.columns if c not in keep and c != "_q_h")]
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(_at("_q_h", i + k) for k in range(window)))))
    adjacent = F.when(n >= 2, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: _at("_q_h", i) == _at("_q_h", i - 1)))).otherwise(0)
    out = out.select(*made, F.size(F.array_distinct("_q_h")).cast("long").alias("n_distinct"), adjacent.cast("long").alias("n_adjacent"), windows.alias("_q_w"))
    made += ["n_distinct", "n_adjacent"]
    repeated = F.size(F.array_distinct("_q_w")) < F.size("_q_w")
    out = out.select(*made, F.when(repeated, F.array_sort(F.transform("_q_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_q_s"))
    same = lambda k, j: F.coalesce(_at("_q_s", k)["h"] == _at("_q_s", j)["h"], F.lit(False))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.size("_q_s") - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), _at("_q_s", k)["i"])), lambda x: x.isNotNull())
    out = out.select(*made, F.when(F.col("_q_s").isNotNull(), F.sort_array(starts)).alias("_q_p"))
    covered = F.aggregate(
        "_q_p",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct((p + window).alias("end"), (s["n"] + window - F.greatest(s["end"] - p, F.lit(0))).alias("n")),
        lambda s: s["n"],
    )
    return out.select(*made, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """Rule -> 1 (good), 0 (bad) or null (abstains)."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).cast("int")

    def share(c: str, of: Column = words) -> Column:
        return F.col(c) / of

    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    long_enough = F.col("n_words") >= 20
    # a rule that knows one defect only abstains where it finds none; two can speak for a text
    found = [
        rule(F.col("n_words") < 8, F.lit(False)),
        rule(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        rule((share("n_dup_lines", lines) > 0.3) & (F.col("n_lines") >= 4), F.lit(False)),
        rule(share("n_repeat_words") > 0.3, F.lit(False)),
        rule((share("word_chars") < 2.5) | (share("word_chars") > 11), F.lit(False)),
        rule((share("n_function") < 0.02) & long_enough, share("n_function") >= 0.08),
        rule(share("n_adjacent") > 0.15, F.lit(False)),
        rule((share("n_distinct") < 0.2) & long_enough, F.lit(False)),
        rule((share("n_ended", lines) < 0.1) & (F.col("n_lines") >= 5), F.lit(False)),
        rule(share("n_upper", chars) > 0.5, F.lit(False)),
    ]
    return dict(zip(RULES, found))


def _posterior(model: dict, names: dict[str, Column]) -> Column:
    """Probability of good, given the votes in columns `names`; who abstains says nothing."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, vote in names.items():
        weight = math.log(model["right"][r] / (1 - model["right"][r]))
        odds = odds + F.when(vote == 1, weight).when(vote == 0, -weight).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, rounds: int = 40, tolerance: float = 1e-4) -> dict:
    """The share of good documents, and how often each rule is right where it votes.

    Every rule starts at 0.8 and is taken to be right more often than not; ten votes at
    that accuracy are added to each, so that no estimate is 0 or 1 and a rule that
    seldom votes keeps to its start.
    """
    # at most 3 ** len(RULES) rows
    patterns = voted.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).orderBy(*RULES).collect()
    model = {"prior": 0.8, "right": dict.fromkeys(RULES, 0.8)}
    if not patterns:
        return model
    sign = np.array([[0 if p[r] is None else 2 * p[r] - 1 for r in RULES] for p in patterns], dtype=np.float64)
    n = np.array([p["n"] for p in patterns], dtype=np.float64)
    cast = n @ np.abs(sign)
    for _ in range(rounds):
        right = np.array([model["right"][r] for r in RULES])
        odds = math.log(model["prior"] / (1 - model["prior"])) + sign @ np.log(right / (1 - right))
        good = 1 / (1 + np.exp(-odds))
        agreed = (n * good) @ (sign > 0) + (n * (1 - good)) @ (sign < 0)
        found = np.clip((agreed + 8) / (cast + 10), 0.501, 0.999)
        model = {"prior": min(0.999, max(0.001, float((n @ good + 1) / (n.sum() + 2)))), "right": dict(zip(RULES, found.tolist()))}
        if np.abs(found - right).max() < tolerance:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts, a vote for each rule, base_failed, p_good and kept."""
    counted = counts(docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_in")), "_q_in").drop("_q_in")
    voted = checkpoint(counted.select("*", *(v.alias(r) for r, v in votes().items())))
    model = estimate(voted)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    p = _posterior(model, {r: F.col(r) for r in RULES})
    return voted.select(F.col("_q_id").alias(id_col), *COUNTS, *RULES, base_failed.alias("base_failed"), p.alias("p_good"), (~base_failed & (p >= 0.5)).alias("kept"))
