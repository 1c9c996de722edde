"""Job state from a stream of updates, and uploads from a folder."""

from pyspark.sql import functions as F

from quirefold.operators import jobs
from quirefold.streaming import jobs as streaming


def test_latest_state_survives_repeats(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a", 1, "queued"), ("b", 1, "queued"), ("a", 2, "running"), ("a", 3, "completed"), ("b", 2, "failed")]
    for k in range(0, 5, 2):
        spark.createDataFrame(rows[k : k + 2], "id string, updated_at long, status string").coalesce(1).write.mode("append").parquet(log)
    schema = spark.read.parquet(log).schema
    seen = []
    for _ in range(2):
        streaming.keep_latest(streaming.updates(spark, log, schema, 1), str(tmp_path / "table"), str(tmp_path / "ck"), then=lambda b: seen.append(b.count())).awaitTermination()
    assert sorted(map(tuple, streaming.latest_table(spark, str(tmp_path / "table")).select("id", "status").collect())) == [("a", "completed"), ("b", "failed")]
    assert sum(seen) == 5


def test_deltas_are_folded(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    rows = [(k % 3, n, f"{k}-{n}") for n in range(2) for k in range(3)] + [(3, 9, "last")]
    for row in rows:
        spark.createDataFrame([row], "id long, updated_at long, status string").coalesce(1).write.mode("append").parquet(log)
    stream = streaming.updates(spark, log, spark.read.parquet(log).schema, 1)
    streaming.keep_latest(stream, table, str(tmp_path / "ck"), compact=2).awaitTermination()
    folders = {kind: [v for v, _ in streaming._folders(spark, table, kind)] for kind in ("base", "delta")}
    assert folders == {"base": [4, 6], "delta": [5, 6]}
    want = [(0, "0-1"), (1, "1-1"), (2, "2-1"), (3, "last")]
    assert sorted(map(tuple, streaming.latest_table(spark, table).select("id", "status").collect())) == want
    (tmp_path / "table" / "delta" / "version=7").mkdir()  # a batch that has not finished
    assert streaming.latest_table(spark, table).count() == 4


def test_uploads(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.pdf", b"%PDF-1"), ("b.pdf", b"nope"), ("c.txt", b"%PDF-1")):
        (folder / name).write_bytes(content)
    q = streaming.accepted(streaming.uploads(spark, str(folder))).select("filename").writeStream.format("memory").queryName("uploaded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.filename for r in spark.table("uploaded").collect()] == ["a.pdf"]


def test_job_rows(spark):
    asked = spark.createDataFrame([("a" * 32, "f.pdf", '{"ocr": "auto", "password": "s\\"x", "n": 1}', 5), ("b" * 32, "g.pdf", '{"n": 1, "password": null}', 6)], "id string, filename string, options_json string, created_at long")
    made = jobs.inserted(asked)
    assert [r.options_json for r in made.orderBy("id").collect()] == ['{"ocr": "auto", "n": 1}', '{"n": 1}']
    assert made.where(jobs.is_valid(made)).count() == 2
    assert jobs.newest(made, 0).count() == 1 and "output_dir" not in jobs.public_view(made).columns
    assert jobs.lookup(made, "a" * 32).count() == 1
    assert jobs.deleted(made.withColumn("status", F.lit("running")), made.select("id")).count() == 2


def test_queued_jobs_run_and_failures_are_kept(spark, tmp_path):
    log = str(tmp_path / "queue")
    for k, name in enumerate(("good", "bad")):
        rows = [(f"{k}{n}" * 16, "queued", name, 0, "queued", None, n) for n in range(2)]
        spark.createDataFrame(rows, "id string, status string, filename string, progress int, stage string, error string, updated_at long").coalesce(1).write.mode("append").parquet(log)

    def work(batch):
        if batch.where("filename = 'bad'").count():
            raise ValueError("no such page")
        return batch.withColumns({"status": F.lit("completed"), "progress": F.lit(100), "updated_at": F.col("updated_at") + 1})

    schema = spark.read.parquet(log).schema
    streaming.run_queued(streaming.updates(spark, log, schema, 1), work, str(tmp_path / "state"), str(tmp_path / "ck2")).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/state/version=1/all").groupBy("filename", "status", "error").count().collect()
    assert sorted(map(tuple, got)) == [("bad", "failed", "no such page", 2), ("good", "completed", None, 2)]
