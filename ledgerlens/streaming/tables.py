"""Streams that keep a table up to date: every micro-batch adds the rows that it changed, under its own number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.sources.tables import shared_dir


def table_path(spark: SparkSession, name: str) -> str:
    """A new place for a table below the folder that driver and executors share."""
    return f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def run_to_table(changes: DataFrame, path: str, mode: str = "update") -> None:
    """Runs a stream of changed rows over all input that is there, into the table at ``path``, and ends.

    Changes are below ``path``/changes and the stream's own notes below ``path``/checkpoint: a later call with the same path goes on where
    the last one stopped, after a failure too. A batch that is repeated overwrites its own rows, so it counts once.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/changes/n={number}")

    changes.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """The newest row of each key of a table that run_to_table keeps; schema: that of the changes, for a table without a batch yet."""
    from py4j.protocol import Py4JJavaError

    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    try:
        empty = not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    except Py4JJavaError as e:
        raise OSError(f"cannot look at {path}") from e
    if empty:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/changes")
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_batch")
