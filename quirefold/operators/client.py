"""What a client derives from jobs, issues and files: admission, summaries, filters and captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema


def admit(files: DataFrame, cap: int = schema.MAX_BATCH_FILES, max_bytes: int = schema.MAX_FILE_BYTES) -> DataFrame:
    """`files` (nth, name, size, modified) with the reason each is turned away for: type, size, duplicate
    or overflow; null if it is admitted. Only the first `cap` that pass are ever sorted out and broadcast.
    """
    refused = F.when(~F.lower("name").rlike(r"\.pdf\z"), "type").when(F.col("size") > max_bytes, "size")
    marked = files.withColumn("_refused", refused)
    same = Window.partitionBy("name", "size", "modified", F.col("_refused").isNull())
    marked = marked.withColumn("_first", F.min("nth").over(same))
    passing = marked.where("_refused is null and nth = _first").orderBy("nth").limit(cap).select(F.col("nth").alias("_first"), F.lit(True).alias("_in"))
    reason = F.coalesce("_refused", F.when(F.col("_in").isNull(), "overflow").when(F.col("nth") != F.col("_first"), "duplicate"))
    return marked.join(F.broadcast(passing), "_first", "left").select(*files.columns, reason.alias("reason"))


def batch_summary(items: DataFrame, *group: str) -> DataFrame:
    """Counts by state and mean progress: done and failed count 100, uploading 8. items: state, progress."""
    done = F.when(F.col("state").isin("completed", "failed"), 100.0).when(F.col("state") == "uploading", 8.0).when(F.col("state") == "ready", 0.0).otherwise(F.col("progress").cast("double"))
    states = ("ready", "uploading", "queued", "running", "completed", "failed")
    return items.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in states), F.round(F.avg(done), 2).alias("progress"))


def caption() -> Column:
    """One line on a batch, from the columns of batch_summary."""
    c = F.col
    busy = c("uploading") + c("queued") + c("running")
    return (
        F.when(c("total") == 0, "no files")
        .when(busy > 0, F.format_string("%d of %d done, %d in progress", c("completed") + c("failed"), c("total"), busy))
        .when(c("failed") == c("total"), "all failed")
        .when(c("failed") > 0, F.format_string("%d done, %d failed", c("completed"), c("failed")))
        .when(c("completed") == c("total"), "all done")
        .otherwise(F.format_string("%d to submit", c("ready")))
    )


def merge_updates(known: DataFrame, updates: DataFrame, limit: int = 100) -> DataFrame:
    """Updates win over what is known of an id; the newest by creation, `limit` at most."""
    both = known.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    row = F.struct(*(F.col(c) for c in known.columns))
    merged = both.groupBy("id").agg(F.max_by(row, F.struct("_new", "updated_at")).alias("_r")).select("_r.*")
    return merged.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def issues_of_page(issues: DataFrame, page: Column | int) -> DataFrame:
    """Issues of one page with those of the whole document, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.where(F.col("page").isNull() | (F.col("page") == page)).withColumn("rank", rank)


def metric_list(documents: DataFrame, metrics: list[str]) -> DataFrame:
    """(doc_id, metric, value) of the metrics that a document has."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    return documents.select("doc_id", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)")).where("value is not null")


def preview(markdown: Column, limit: int = 250_000) -> Column:
    """Without front matter, cut at `limit` characters."""
    return F.left(F.regexp_replace(markdown, r"\A\uFEFF?---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)", ""), F.lit(limit))


def bytes_label(n: Column) -> Column:
    """KB with one decimal below a megabyte; MB above, without decimals if it is whole."""
    mb = n / (1024.0 * 1024.0)
    one = lambda x, unit: F.concat(F.round(x, 1).cast("decimal(18,1)").cast("string"), F.lit(unit))
    return F.when(n < 1024 * 1024, one(n / 1024.0, " KB")).when(mb == F.floor(mb), F.concat(F.floor(mb).cast("string"), F.lit(" MB"))).otherwise(one(mb, " MB"))


def selected_downloads(selected: DataFrame, downloadable: DataFrame) -> DataFrame:
    return selected.select("id").intersect(downloadable.select("id"))
