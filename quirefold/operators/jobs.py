"""The job table as an append log: one row an update, the latest of each id is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema

# Progress of the stages of a conversion; parse and fallback scale the engine's own progress.
STAGES = [("queued", 0.0, 0.0), ("inspect", 3.0, 0.0), ("prepare", 10.0, 0.0), ("parse", 12.0, 0.5), ("retry", 16.0, 0.0), ("native", 18.0, 0.0), ("score", 64.0, 0.0), ("fallback", 68.0, 0.17), ("render", 88.0, 0.0), ("completed", 100.0, 0.0)]
UPDATABLE = ["status", "progress", "stage", "error", "output_dir", "quality_score"]
ID = "^[0-9a-f]{32}$"


def latest(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key; map-side combined."""
    row = F.struct(*(F.col(c) for c in log.columns))
    return log.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def current(inserts: DataFrame, updates: DataFrame) -> DataFrame:
    """State of each job: its insert with, for each updatable column, the last update that sets it."""
    last = updates.groupBy("id").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(f"_{c}") for c in UPDATABLE), F.max("updated_at").alias("_at")
    )
    joined = inserts.join(last, "id", "left")
    made = {c: F.coalesce(f"_{c}", c) for c in UPDATABLE} | {"updated_at": F.coalesce("_at", "updated_at")}
    return joined.select(*(made.get(c, F.col(c)).alias(c) for c in inserts.columns))


def recovered(jobs: DataFrame, reason: str = "interrupted by a restart") -> DataFrame:
    """On start: jobs that were queued or running have failed."""
    open_ = F.col("status").isin("queued", "running")
    made = {"status": F.when(open_, "failed").otherwise(F.col("status")), "error": F.when(open_, reason).otherwise(F.col("error")), "stage": F.when(open_, "failed").otherwise(F.col("stage"))}
    return jobs.select(*(made.get(c, F.col(c)).alias(c) for c in jobs.columns))


def newest(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The last jobs by creation; the limit is kept within 1 to 100."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(100, limit)))


def lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    found = jobs.where(F.col("id") == job_id)
    if found.isEmpty():
        raise KeyError(job_id)
    return found


def deletable(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Which of `ids` may go: known and not running."""
    return ids.join(jobs.where("status <> 'running'"), "id", "left_semi")


def deleted(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(deletable(jobs, ids), "id", "left_anti")


def public_view(jobs: DataFrame) -> DataFrame:
    return jobs.drop("output_dir")


def completed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(jobs.where("status = 'completed'"), "id", "left_semi")


def is_id(c: Column) -> Column:
    return c.rlike(ID)


def progress(stage: Column, inner: Column) -> Column:
    """Overall progress at a stage, with the engine's own progress inside it; 0 to 100."""
    out = F.lit(0.0)
    for name, start, scale in STAGES:
        out = F.when(stage == name, F.lit(start) + scale * F.greatest(F.lit(0), F.least(F.lit(100), inner))).otherwise(out)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), out))).cast("int")


def redacted(error: Column, paths: list[str]) -> Column:
    """An error without local paths in either slash style, cut at 1,000 characters."""
    out = error
    for p in sorted({x for p in paths for x in (p, p.replace("/", "\\"), p.replace("\\", "/"))}, key=len, reverse=True):
        out = F.replace(out, F.lit(p), F.lit("<path>"))
    return F.left(out, F.lit(1000))


def inserted(requests: DataFrame) -> DataFrame:
    """New job rows of requests (id, filename, options_json, created_at), without passwords."""
    options = F.regexp_replace("options_json", r'"password"\s*:\s*(?:"(?:[^"\\]|\\.)*"|null)\s*,?\s*', "")
    options = F.regexp_replace(options, r",\s*}", "}")
    # a password that is neither text nor null: the options are read and written without it
    others = F.to_json(F.map_filter(F.from_json("options_json", "map<string,variant>"), lambda k, _: k != "password"))
    options = F.when(F.contains(options, F.lit("password")), F.coalesce(others, F.lit("{}"))).otherwise(options)
    return requests.select(
        "id", F.lit("queued").alias("status"), "filename", F.lit(0).alias("progress"), F.lit("queued").alias("stage"), "created_at", F.col("created_at").alias("updated_at"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("output_dir"), F.lit(None).cast("double").alias("quality_score"), options.alias("options_json"),
    )


def is_valid(jobs: DataFrame) -> Column:
    return F.col("status").isin(schema.JOB_STATES) & F.col("progress").between(0, 100) & is_id(F.col("id"))
