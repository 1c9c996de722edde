"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """`df`, computed and written to the folder that spark.checkpoint.dir names.

    Only a session on one machine (a test) may do without that setting and gets a folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


#: Bytes of input for each core below which an input is spread.
SPLIT = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores if its input is estimated at less than SPLIT bytes a core; otherwise as it is.

    Files of that size are often one split. Larger inputs never pay this shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n, *keys) if size < n * SPLIT else df
