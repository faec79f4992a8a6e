"""Execution logs as a stream: grouped figures that grow with the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.streaming.tables import latest, run_to_table, table_path


def group_stream(stream: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Count, count above the threshold and sum by key, for a sink in complete or update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(value) > threshold).alias("n_valid"), F.avg(value).alias("avg_value"))


def windowed_stream(stream: DataFrame, time: str, key: str, value: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """The same by time windows; rows later than ``late`` are not waited for."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"))


def group_once(spark: SparkSession, folder: str, pattern: str, key: str, value: str, threshold: float, path: str | None = None) -> DataFrame:
    """Runs group_stream over all files that are there into the table at ``path`` (a new one by default), which a later call goes on with, and returns the groups."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    reader = spark.readStream.schema(schema)
    stream = (reader.option("pathGlobFilter", pattern) if pattern.endswith(".parquet") else reader).parquet(folder)
    grouped = group_stream(stream.select(key, value), key, value, threshold)
    path = path or table_path(spark, "groups")
    run_to_table(grouped, path)
    return latest(spark, path, [key], grouped.schema).withColumn("avg_value", F.round("avg_value", 4))
