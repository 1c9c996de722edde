"""URL filters: host rules first, then a tree of path templates for each host.

A rule is a host with a path prefix and fits the host and its subdomains; the longest
fitting rule decides. Other urls are judged by their host's tree of path templates. The
tree grows a level at a time: below each template, a segment that fewer than `min_pages`
pages have is variable and becomes `*`; any other is a branch of its own only if its
labelled pages differ from its siblings' in how many are bad (chi-square test of two
shares, with 5 labels on either side), and otherwise joins the merged branch `+`. Branches
that are worse than their siblings are tested against one another too: those that do not
differ from the rest of them are merged into `+worse`, and likewise into `+better`. The
tree ends by itself, at the first level where no template has `min_pages` pages with more
segments; what is left of a path is then one `**`. A template is rejected if its labelled
purity, the share of good pages smoothed by `weight` pages of the corpus's mean, is under
`least`.

Each level is two counts with map-side combination and a join with the tested segments,
which are broadcast while they are few and joined by key beyond that; hot hosts are never
gathered, and where the join is by key AQE can split their pages. Levels are checkpointed,
and urls without further segments take no part in the next one.

Defined results: a null url or one without `://` has an empty host and path. Labels are
those of rows whose id equals the page's; an id with several labels is bad if one is, and
null labels say nothing. Without labels every template is pure. Repeated pages count
each. Other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import checkpoint

Rule = tuple[str, str, str]
# The rules of the registered query (host, path prefix, verdict).
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, written host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _differs(good: Column, bad: Column, all_good: Column, all_bad: Column, chi_square: float) -> Column:
    """Whether a branch has another share of bad pages than the rest of a whole that it is part of."""
    labelled, other_bad = good + bad, all_bad - bad
    other = all_good + all_bad - labelled
    # chi-square of the two-by-two table good/bad, this branch/its siblings
    cross = bad * (other - other_bad) - other_bad * good
    both = (all_bad * all_good).cast("double") * labelled * other
    return F.when((labelled >= 5) & (other >= 5) & (both > 0), (labelled + other) * cross.cast("double") * cross / both).otherwise(0.0) >= chi_square


def templates(pages: DataFrame, min_pages: int, chi_square: float) -> DataFrame:
    """Rows with host, path, good and bad, plus their path template."""
    c = F.col
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    live = checkpoint(pages.withColumn("parts", parts).withColumn("template", F.lit("")))
    done = [live.where(F.size("parts") == 0)]
    live, level = live.where(F.size("parts") > 0), 0
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    key = ["host", "template"]
    while True:
        here = live.select(*key, F.get("parts", F.lit(level)).alias("part"), "good", "bad")
        child = here.groupBy(*key, "part").agg(*sums)
        node = child.groupBy(*key).agg(*(F.sum(x).alias(f"all_{x}") for x in ("n", "good", "bad"))).where(c("all_n") >= min_pages)
        child = checkpoint(child.where(c("n") >= min_pages).join(node, key).withColumn("own", _differs(c("good"), c("bad"), c("all_good"), c("all_bad"), chi_square)))
        if child.isEmpty() and node.isEmpty():
            break
        own = child.where("own").withColumn("worse", c("bad") * (c("all_good") + c("all_bad")) > c("all_bad") * (c("good") + c("bad")))
        pool = own.groupBy(*key, "worse").agg(F.count(F.lit(1)).alias("branches"), F.sum("good").alias("pool_good"), F.sum("bad").alias("pool_bad"))
        alike = (c("branches") > 1) & ~_differs(c("good"), c("bad"), c("pool_good"), c("pool_bad"), chi_square)
        named = own.join(pool, [*key, "worse"]).select(*key, "part", F.when(alike, F.when(c("worse"), "+worse").otherwise("+better")).otherwise(c("part")).alias("token"))
        token = child.where("not own").select(*key, "part", F.lit("+").alias("token")).union(named)
        step = live.withColumn("part", F.get("parts", F.lit(level))).join(_small(token), [*key, "part"], "left")
        level += 1
        grown = F.concat("template", F.lit("/"), F.coalesce("token", F.lit("*")))
        live = checkpoint(step.select(*(grown.alias(x) if x == "template" else x for x in live.columns)))
        done.append(live.where(F.size("parts") <= level))
        live = live.where(F.size("parts") > level)
        if level % 16 == 0:
            done = [checkpoint(reduce(DataFrame.union, done))]
    done.append(live.withColumn("template", F.concat("template", F.lit("/**"))))
    return reduce(DataFrame.union, done).drop("parts")


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, written once, and broadcast if it has at most `rows` rows; beyond that it is joined by key."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= rows else df


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    min_pages: int = 3,
    chi_square: float = 6.63,
    weight: float = 5.0,
    least: float = 0.5,
) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity); labels: (id, bad) with bad boolean or null."""
    host, path = host_and_path(F.col(url_col))
    known = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).join(known, "id", "left")
    base = base.select("id", "host", "path", F.coalesce(1 - F.col("bad"), F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    grown = checkpoint(templates(base, min_pages, chi_square))
    total = grown.agg(F.sum("good"), F.sum("bad")).first()
    mean = total[0] / (total[0] + total[1]) if total[0] or total[1] else 1.0
    purity = grown.groupBy("host", "template").agg(((F.sum("good") + F.lit(weight * mean)) / (F.sum("good") + F.sum("bad") + F.lit(weight))).alias("purity"))
    impure = purity.where(F.col("purity") < least)
    judged = grown.join(_small(impure), ["host", "template"], "left")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "purity")
