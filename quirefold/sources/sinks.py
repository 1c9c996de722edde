"""Writing results: artifacts of each document, manifests and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import checkpoint

# Files that every result has.
ROOT_FILES = ["document.json", "document.md", "manifest.json", "quality-report.json"]


def is_artifact(path: Column) -> Column:
    """A relative path inside the result: one of the root files, or below assets."""
    inside = ~path.rlike(r"^/|(^|/)\.\.(/|$)|\\") & (path != "")
    return inside & (path.isin(ROOT_FILES) | path.rlike("^assets/."))


def allowed(files: DataFrame) -> DataFrame:
    """(doc_id, path) that may be handed out: allowed, existing, each once."""
    return files.where(is_artifact(F.col("path")) & F.col("exists")).select("doc_id", "path").distinct()


def manifest(documents: DataFrame, reports: DataFrame, assets: DataFrame) -> DataFrame:
    """One row a document: identity, engine, score and the sorted list of its files."""
    files = assets.where(is_artifact(F.col("path"))).groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("extra"))
    root = F.array(*map(F.lit, ROOT_FILES))
    out = documents.join(reports, "doc_id").join(files, "doc_id", "left")
    return out.select(
        "doc_id", F.lit("1.0").alias("schema_version"), F.col("filename").alias("source_filename"), F.col("sha256").alias("source_sha256"), documents["page_count"], F.col("kind").alias("document_kind"), "primary_engine",
        F.col("score").alias("quality_score"), F.col("passed").alias("quality_passed"), F.array_join(F.array_sort(F.array_distinct(F.concat(root, F.coalesce("extra", F.array().cast("array<string>"))))), ",").alias("files"),
    )


#: Folders of an artifact's dataset; the same number for all writes to a path.
BUCKETS = 1024


def bucket(doc_id: Column) -> Column:
    """The folder of a document."""
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(BUCKETS)).cast("int")


def write(path: str, markdown: DataFrame, blocks: DataFrame, reports: DataFrame, manifests: DataFrame) -> None:
    """The four artifacts, each a dataset of JSON lines in buckets of documents; earlier rows of these documents go.

    Only the buckets of these documents are written again, their other documents' lines as they are.
    Those lines lie in the checkpoint folder before a bucket is replaced. Files are balanced by their
    size, so a large bucket is written by several tasks. A dataset's commit is one job's.
    """
    for name, df in (("document.md", markdown), ("document.json", blocks), ("quality-report.json", reports), ("manifest.json", manifests)):
        target = f"{path}/{name}"
        lines = df.select(bucket(F.col("doc_id")).alias("part"), F.to_json(F.struct(*df.columns)).alias("value"))
        if _exists(df.sparkSession, target):
            lines = lines.unionByName(_others(df, target))
        lines.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(target)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path has a partition folder, on any file system that Spark reads."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/part=*")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder))


def _others(df: DataFrame, target: str) -> DataFrame:
    """The lines of other documents in the buckets of `df`, kept in the checkpoint folder."""
    ids = df.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    touched = ids.select(bucket(F.col("doc_id")).alias("part")).distinct()  # BUCKETS rows at most
    old = df.sparkSession.read.schema("value string, part int").text(target)
    old = old.join(F.broadcast(touched), "part", "left_semi").withColumn("doc_id", F.get_json_object("value", "$.doc_id").cast("long"))
    return checkpoint(old.join(ids, "doc_id", "left_anti").select("part", "value"))


def archive_problem(asked: DataFrame, jobs: DataFrame, sizes: DataFrame, max_files: int = S.MAX_BATCH_FILES, max_bytes: int = S.MAX_ARCHIVE_BYTES, by: tuple[str, ...] = ()) -> DataFrame:
    """Why a batch archive of job ids (nth, id) is refused, or null: one row, or one for each request that columns `by` name."""
    whole = asked.join(jobs.select("id", "status"), "id", "left").join(sizes.groupBy("id").agg(F.sum("size").alias("size")), "id", "left")
    n = whole.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("distinct"), F.count_if(~F.col("id").rlike("^[0-9a-f]{32}$")).alias("bad"), F.count_if(F.coalesce("status", F.lit("")) != "completed").alias("open"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
    why = (
        F.when(F.col("n") == 0, "empty").when(F.col("n") > max_files, "too_many").when(F.col("distinct") < F.col("n"), "duplicates").when(F.col("bad") > 0, "bad_id").when(F.col("open") > 0, "not_completed").when(F.col("bytes") > max_bytes, "too_large")
    )
    return n.select(*by, why.alias("reason"))


def archive_folders(asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, nth, id, folder): results/NN-first eight characters, numbered in each request, which is small."""
    order = Window.partitionBy(*by).orderBy("nth")
    return asked.select(*by, "nth", "id", F.format_string("results/%02d-%s", F.row_number().over(order), F.left("id", F.lit(8))).alias("folder"))


def zip_results(spark: SparkSession, path: str, ids: list[int], target: str, max_files: int = S.MAX_BATCH_FILES, max_bytes: int = S.MAX_ARCHIVE_BYTES) -> None:
    """A ZIP file on the driver of the artifacts of a few documents, within the limits of a batch archive."""
    import zipfile

    from . import readers

    if len(ids) > max_files or len(set(ids)) < len(ids):
        raise ValueError(f"{len(ids)} ids: at most {max_files}, each once")
    total = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for n, doc_id in enumerate(ids, start=1):
            for name in ROOT_FILES:
                rows = readers.result(spark, path, name, doc_id)
                size = rows.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
                total += size
                if total > max_bytes:
                    raise ValueError(f"more than {max_bytes} bytes")
                lines = [r.markdown for r in rows.collect()] if name.endswith(".md") else [r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()]
                bundle.writestr(f"results/{n:02d}-{doc_id}/{name}", "\n".join(lines))
