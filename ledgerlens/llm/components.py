"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import delete_path, scratch_path

ROUNDS = 60


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Links may be repeated, in either direction, or from a node to itself; null ends don't link.
    Each round is a table in the shared folder; a hub's links are never gathered in one
    row: its smallest neighbour is an aggregate, joined back, and a join that is skewed by a hub can be split. No links give no rows.
    """
    spark = links.sparkSession
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, state = None, None
    for _ in range(ROUNDS):
        new = scratch_path(spark, "links")
        now.write.parquet(new)
        now = spark.read.schema("u long, v long").parquet(new)
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if path:
            delete_path(spark, path)
        path = new
        if said == state or not said[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = said
        # each link's larger end goes to the smallest neighbour of the smaller one; a hub is the smaller end of its links
        low = now.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        large = now.join(low, now["v"] == low["c"], "left").select("u", F.coalesce("m", "v").alias("v"))
        # each node of `large` now points to smaller ones alone
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
