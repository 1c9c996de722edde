"""Queries on jobs: the table of events is the log, users are jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import client, jobs
from ..sources import sinks
from . import harness as H

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


STATUS = "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END"
LOG = f"log AS (SELECT user_id AS id, event_id, ts AS updated_at, {STATUS} AS status, CAST(event_id % 101 AS INTEGER) AS progress, event_type AS stage FROM events)"
LATEST = LOG + ", latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, event_id DESC) = 1)"


def status():
    k = F.col("event_id") % 4
    return F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "completed").otherwise("failed")


def log(spark, d):
    return H.table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("updated_at"), status().alias("status"), (F.col("event_id") % 101).cast("int").alias("progress"), F.col("event_type").alias("stage"))


def latest(spark, d):
    return jobs.latest(log(spark, d), order=("updated_at", "event_id"))


@query("jobs_latest", f"WITH {LATEST} SELECT id, event_id, status, progress, stage FROM latest")
def jobs_latest(spark, d):
    return latest(spark, d).select("id", "event_id", "status", "progress", "stage")


@query("jobs_current", f"WITH {LOG}, f AS (SELECT id, min(updated_at) AS created_at FROM log GROUP BY id) SELECT f.id, (SELECT arg_max(progress, (updated_at, event_id)) FROM log l WHERE l.id = f.id AND event_id % 3 <> 0) AS progress, (SELECT arg_max(stage, (updated_at, event_id)) FROM log l WHERE l.id = f.id AND event_id % 5 <> 0) AS stage FROM f")
def jobs_current(spark, d):
    """Updates that leave some columns as they were: the last value that was set counts."""
    own = log(spark, d)
    order = F.struct("updated_at", "event_id")
    updates = own.select("id", order.alias("updated_at"), F.when(F.col("event_id") % 3 != 0, F.col("progress")).alias("progress"), F.when(F.col("event_id") % 5 != 0, F.col("stage")).alias("stage"), *(F.lit(None).cast("string").alias(c) for c in ("status", "error", "output_dir", "quality_score")))
    inserts = own.groupBy("id").agg(F.min(order).alias("updated_at")).select("id", "updated_at", *(F.lit(None).cast(t).alias(c) for c, t in (("progress", "int"), ("stage", "string"), ("status", "string"), ("error", "string"), ("output_dir", "string"), ("quality_score", "string"))))
    return jobs.current(inserts, updates).select("id", "progress", "stage")


@query("jobs_newest", f"WITH {LATEST} SELECT id, event_id FROM latest ORDER BY updated_at DESC, id DESC LIMIT 25")
def jobs_newest(spark, d):
    return jobs.newest(latest(spark, d).withColumnRenamed("updated_at", "created_at"), 25).select("id", "event_id")


@query("restart_recovery", f"WITH {LATEST} SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'interrupted by a restart' END AS error FROM latest")
def restart_recovery(spark, d):
    return jobs.recovered(latest(spark, d).withColumn("error", F.lit(None).cast("string"))).select("id", "status", "error")


@query("completed_jobs", f"WITH {LATEST} SELECT id FROM latest WHERE status = 'completed' AND id % 2 = 0")
def completed_jobs(spark, d):
    own = latest(spark, d)
    return jobs.completed(own, own.where("id % 2 = 0").select("id"))


@query("deleted_jobs", f"WITH {LATEST} SELECT id, status FROM latest WHERE NOT (id % 3 = 0 AND status <> 'running')")
def deleted_jobs(spark, d):
    own = latest(spark, d)
    return jobs.deleted(own, own.where("id % 3 = 0").select("id")).select("id", "status")


@query("stage_progress", "SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN floor(12 + 0.5 * (event_id % 101)) WHEN 2 THEN floor(68 + 0.17 * (event_id % 101)) ELSE 88 END AS INTEGER) AS progress FROM events")
def stage_progress(spark, d):
    k = F.col("event_id") % 4
    stage = F.when(k == 0, "inspect").when(k == 1, "parse").when(k == 2, "fallback").otherwise("render")
    return H.table(spark, d, "events").select("event_id", jobs.progress(stage, (F.col("event_id") % 101).cast("double")).alias("progress"))


@query("redacted_errors", "SELECT event_id, left('cannot read <path>/a.pdf or <path> ' || repeat('x', CAST(event_id % 1100 AS INTEGER)), 1000) AS error FROM events")
def redacted_errors(spark, d):
    error = F.concat(F.lit("cannot read /srv/data/u/a.pdf or \\srv\\data\\u "), F.repeat(F.lit("x"), (F.col("event_id") % 1100).cast("int")))
    return H.table(spark, d, "events").select("event_id", jobs.redacted(error, ["/srv/data/u"]).alias("error"))


@query("valid_job_ids", "SELECT event_id, event_id % 3 = 0 AS valid FROM events")
def valid_job_ids(spark, d):
    digest = F.md5(F.col("event_id").cast("string"))
    shown = F.when(F.col("event_id") % 3 == 0, digest).when(F.col("event_id") % 3 == 1, F.concat(digest, F.lit("0"))).otherwise(F.concat(F.lit("G"), F.left(digest, F.lit(31))))
    return H.table(spark, d, "events").select("event_id", jobs.is_id(shown).alias("valid"))


@query("public_jobs", f"WITH {LATEST} SELECT id, status FROM latest")
def public_jobs(spark, d):
    return jobs.public_view(latest(spark, d).select("id", "status", F.lit("/srv").alias("output_dir")))


STATE = "CASE event_id % 7 WHEN 0 THEN 'ready' WHEN 1 THEN 'uploading' WHEN 2 THEN 'queued' WHEN 3 THEN 'running' WHEN 4 THEN 'completed' WHEN 5 THEN 'failed' ELSE 'running' END"
SUMMARY = f"summary AS (SELECT user_id AS batch, count(*) AS total, count(*) FILTER (WHERE s = 'ready') AS ready, count(*) FILTER (WHERE s = 'uploading') AS uploading, count(*) FILTER (WHERE s = 'queued') AS queued, count(*) FILTER (WHERE s = 'running') AS running, count(*) FILTER (WHERE s = 'completed') AS completed, count(*) FILTER (WHERE s = 'failed') AS failed, round(avg(CASE WHEN s IN ('completed', 'failed') THEN 100.0 WHEN s = 'uploading' THEN 8.0 WHEN s = 'ready' THEN 0.0 ELSE event_id % 101 END), 2) AS progress FROM (SELECT *, {STATE} AS s FROM events) GROUP BY user_id)"


def summary(spark, d):
    k = F.col("event_id") % 7
    state = F.when(k == 0, "ready").when(k == 1, "uploading").when(k == 2, "queued").when(k == 4, "completed").when(k == 5, "failed").otherwise("running")
    items = H.table(spark, d, "events").select(F.col("user_id").alias("batch"), state.alias("state"), (F.col("event_id") % 101).alias("progress"))
    return client.batch_summary(items, "batch")


@query("batch_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def batch_summary(spark, d):
    return summary(spark, d)


@query("batch_captions", f"WITH {SUMMARY} SELECT batch, CASE WHEN uploading + queued + running > 0 THEN (completed + failed) || ' of ' || total || ' done, ' || (uploading + queued + running) || ' in progress' WHEN failed = total THEN 'all failed' WHEN failed > 0 THEN completed || ' done, ' || failed || ' failed' WHEN completed = total THEN 'all done' ELSE ready || ' to submit' END AS caption FROM summary")
def batch_captions(spark, d):
    return summary(spark, d).select("batch", client.caption().alias("caption"))


@query("merge_updates", f"WITH {LOG}, both_ AS (SELECT id, event_id, status, updated_at AS created_at, updated_at, CAST(event_id % 2 AS INTEGER) AS fresh FROM log), m AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY fresh DESC, updated_at DESC) = 1) SELECT id, event_id, status FROM m ORDER BY created_at DESC, id DESC LIMIT 100")
def merge_updates(spark, d):
    own = log(spark, d).select("id", "event_id", "status", F.col("updated_at").alias("created_at"), "updated_at")
    return client.merge_updates(own.where("event_id % 2 = 0"), own.where("event_id % 2 = 1")).select("id", "event_id", "status")


FILES = "files AS (SELECT event_id AS nth, CASE WHEN event_id % 9 = 0 THEN 'a.txt' ELSE 'f' || (event_id % 40) || '.PDF' END AS name, CASE WHEN event_id % 11 = 0 THEN 300000000 ELSE event_id % 40 + 1 END AS size, CAST(0 AS BIGINT) AS modified FROM events)"


@query(
    "upload_admission",
    f"WITH {FILES}, r AS (SELECT *, CASE WHEN name = 'a.txt' THEN 'type' WHEN size > 209715200 THEN 'size' END AS refused FROM files), f AS (SELECT *, min(nth) OVER (PARTITION BY name, size, modified, refused IS NULL) AS first FROM r), p AS (SELECT nth FROM f WHERE refused IS NULL AND nth = first ORDER BY nth LIMIT 20) SELECT f.nth, coalesce(refused, CASE WHEN p.nth IS NULL THEN 'overflow' WHEN f.nth <> f.first THEN 'duplicate' END) AS reason FROM f LEFT JOIN p ON p.nth = f.first",
)
def upload_admission(spark, d):
    k = F.col("event_id")
    files = H.table(spark, d, "events").select(k.alias("nth"), F.when(k % 9 == 0, "a.txt").otherwise(F.concat(F.lit("f"), (k % 40).cast("string"), F.lit(".PDF"))).alias("name"), F.when(k % 11 == 0, 300_000_000).otherwise(k % 40 + 1).alias("size"), F.lit(0).cast("long").alias("modified"))
    return client.admit(files).select("nth", "reason")


@query("selected_intersection", f"WITH {LATEST} SELECT id FROM latest WHERE status = 'completed' INTERSECT SELECT id FROM latest WHERE id % 5 < 3")
def selected_intersection(spark, d):
    own = latest(spark, d)
    return client.selected_downloads(own.where("id % 5 < 3"), own.where("status = 'completed'"))


@query("batch_archive", f"WITH {LATEST}, a AS (SELECT id, id // 20 AS batch, row_number() OVER (PARTITION BY id // 20 ORDER BY id) AS nth FROM latest WHERE status = 'completed') SELECT batch, nth, 'results/' || lpad(CAST(nth AS VARCHAR), 2, '0') || '-' || left(md5(CAST(id AS VARCHAR)), 8) AS folder, CAST(NULL AS VARCHAR) AS refused FROM a")
def batch_archive(spark, d):
    """Every completed job; a request holds the completed ones of twenty ids in a row, the limit of a batch."""
    done = latest(spark, d).where("status = 'completed'")
    asked = done.select(F.expr(f"id div {S.MAX_BATCH_FILES}").alias("batch"), F.col("id").alias("nth"), F.md5(F.col("id").cast("string")).alias("id"))
    known = done.select(F.md5(F.col("id").cast("string")).alias("id"), "status")
    sizes = known.select("id", F.lit(1000).alias("size"))
    why = sinks.archive_problem(asked, known, sizes, by=("batch",)).select("batch", F.col("reason").alias("refused"))
    folders = sinks.archive_folders(asked, by=("batch",)).select("batch", F.regexp_extract("folder", r"/(\d+)-", 1).cast("long").alias("nth"), "folder")
    return folders.join(why, "batch").select("batch", "nth", "folder", "refused")
