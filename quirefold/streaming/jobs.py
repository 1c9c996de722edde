"""Jobs as a stream: uploads from a folder, and the latest state of each job in a table.

Updates are applied at least once and keyed by job id, so a batch that is repeated after a
failure leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import jobs
from ..sources import inspect


def uploads(spark: SparkSession, path: str, pattern: str = "*.pdf", max_files: int = 100) -> DataFrame:
    """A stream of files (path, modificationTime, length, content) that arrive in a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(path)


def accepted(stream: DataFrame) -> DataFrame:
    return inspect.accept(stream)[0]


def updates(spark: SparkSession, path: str, schema: StructType, max_files: int = 100) -> DataFrame:
    """A stream of job updates from Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def keep_latest(stream: DataFrame, table: str, checkpoint: str, key: str = "id", order: tuple[str, ...] = ("updated_at",), then: Callable[[DataFrame], None] | None = None, compact: int = 50) -> StreamingQuery:
    """Keep the last update of each key in the Parquet dataset `table`. `then` gets the rows of each batch.

    A batch writes its own rows only, as a delta; each `compact`-th batch folds the deltas since the
    last base into a new one, so a row is written again once in `compact` batches and readers meet
    `compact` deltas at most. What is older than the base before that goes. Only folders that Spark
    has marked as finished count, so readers never see half a batch, and a repeated batch replaces its own.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = jobs.latest(batch, key, order)
        new.write.mode("overwrite").parquet(f"{table}/delta/version={epoch}")
        if epoch and epoch % compact == 0:
            _state(spark, table, key, order, epoch + 1, epoch).write.mode("overwrite").parquet(f"{table}/base/version={epoch}")
            _drop_old(spark, table)
        if then is not None:
            then(batch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, table: str, kind: str):
    """(version, folder) of the finished versions of a kind, in order."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{kind}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    folders = [m.getPath().getParent() for m in found]
    return sorted(((int(f.getName().rpartition("=")[2]), f) for f in folders), key=lambda x: x[0])


def _state(spark: SparkSession, table: str, key: str, order: tuple[str, ...], before: int | None = None, base_before: int | None = None) -> DataFrame:
    """The last rows by key of the newest base and of the deltas after it, of versions below the bounds."""
    bases = [(v, f) for v, f in _folders(spark, table, "base") if base_before is None or v < base_before][-1:]
    since = bases[0][0] if bases else -1
    deltas = [(v, f) for v, f in _folders(spark, table, "delta") if v > since and (before is None or v < before)]
    return jobs.latest(spark.read.parquet(*(f.toString() for _, f in bases + deltas)), key, order)


def _drop_old(spark: SparkSession, table: str) -> None:
    """Remove what came before the last base but one: readers may still be at that one."""
    bases = _folders(spark, table, "base")
    if len(bases) < 2:
        return
    for kind, last in (("base", bases[-2][0] - 1), ("delta", bases[-2][0])):
        for version, folder in _folders(spark, table, kind):
            if version <= last:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def latest_table(spark: SparkSession, table: str, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key that keep_latest has written; `key` and `order` are those it was given."""
    return _state(spark, table, key, order)


def run_queued(stream: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Run `work` over the queued jobs of each batch and keep every job's latest state in `table`.

    `work` takes job rows and returns them with a final status, error or score. A batch that fails
    as a whole leaves its jobs failed with the reason; a repeated batch runs them again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        queued = jobs.latest(batch, "id").where("status = 'queued'")
        try:
            work(queued).select(*batch.columns).write.mode("overwrite").parquet(f"{table}/version={epoch}/new")
        except Exception as e:
            reason = jobs.redacted(F.lit(str(e)), [])
            failed = {"status": F.lit("failed"), "stage": F.lit("failed"), "error": reason}
            queued.select(*(failed.get(c, F.col(c)).alias(c) for c in batch.columns)).write.mode("overwrite").parquet(f"{table}/version={epoch}/new")
        new = spark.read.parquet(f"{table}/version={epoch}/new")
        old = spark.read.parquet(f"{table}/version={epoch - 1}/all") if epoch else new.limit(0)
        jobs.latest(old.unionByName(new), "id").write.mode("overwrite").parquet(f"{table}/version={epoch}/all")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
