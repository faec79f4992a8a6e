"""A table of documents that batches are appended to, each batch and each document once, whoever writes at the same time.

A batch's rows are written under a name of their own first; it counts from the moment that its manifest entry exists. The
entry is named after the batch's content and made by a call that fails if it is there, so of two writers of the same batch one wins.
Of batches that share documents the earliest committed one gives them: readers go by the manifest, never by what lies in the folder.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def content_key(batch: DataFrame) -> str:
    """The same for the same rows in any order: their number, and the sum and the exclusive or of their hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(batch.columns)])
    r = batch.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return "-".join("0" if x is None else str(x).replace("-", "m") for x in r)


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The manifest's entries in the order of their commits: key, data, at. One small file a batch."""
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    rows = spark.read.option("wholetext", True).text(f"{path}/manifest/*.json").collect() if fs.listStatus(folder) else []
    return sorted((json.loads(r[0]) for r in rows if r[0].strip()), key=lambda e: (e["at"], e["key"]))


def append_batch(batch: DataFrame, path: str) -> bool:
    """Adds a batch to the store at ``path``; false if the same batch is there, or another writer was first with it.

    A failure before the commit leaves rows that no manifest names and no reader sees.
    """
    spark = batch.sparkSession
    key = content_key(batch)
    fs, entry = _fs(spark, f"{path}/manifest/{key}.json")
    if fs.exists(entry):
        return False
    data = f"data/{uuid.uuid4().hex}"
    batch.write.parquet(f"{path}/{data}")
    return _commit(spark, path, key, data)


def _commit(spark: SparkSession, path: str, key: str, data: str) -> bool:
    from py4j.protocol import Py4JJavaError

    fs, entry = _fs(spark, f"{path}/manifest/{key}.json")
    try:
        out = fs.create(entry, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        left, folder = _fs(spark, f"{path}/{data}")
        left.delete(folder, True)
        return False
    out.write(bytearray(json.dumps({"key": key, "data": data, "at": time.time_ns()}).encode()))
    out.close()
    return True


def read_store(spark: SparkSession, path: str, key: str = "doc_id", schema=None) -> DataFrame:
    """Rows of committed batches; of a document that several batches have, those of the earliest. Rows without a key all stay.

    schema: that of the rows, for a store without a batch yet.
    """
    batches = committed(spark, path)
    if not batches:
        if schema is None:
            raise ValueError(f"no batch in {path}, and no schema to read it by")
        return spark.createDataFrame([], schema)
    rows = None
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(*[f"{path}/{b['data']}" for b in batches])
    order = spark.createDataFrame([(b["data"].rsplit("/", 1)[-1], i) for i, b in enumerate(batches)], "_name string, _turn int")
    named = rows.withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -2)).join(F.broadcast(order), "_name").drop("_name")
    first = named.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("_turn").alias("_first"))
    kept = named.join(first, named[key] == first["_key"], "left").where(F.col("_first").isNull() | (F.col("_turn") == F.col("_first")))
    return kept.drop("_turn", "_key", "_first")
