"""Row numbers and running totals in an order over all rows, without one task that sees them all.

Rows are dealt out by ranges of the order and sorted within each range, as a table in the shared folder: ranges are
chosen by sampling, so that they have to be fixed before anything is counted in them. What stands before a range is the sum of the totals of
the ranges before it; the driver holds those totals, a few numbers for each range.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.tables import written

#: Low bits of monotonically_increasing_id() that hold a row's place within its partition.
PLACE_BITS = 33


def ranged(rows: DataFrame, order: list[Column], name: str = "ranged") -> DataFrame:
    """rows as a table with `_range`, growing with the order, and `_at`, the place within the range from 0.

    Rows that are equal in the order share a range: end the order with something that tells them apart where many may be equal.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    table = written(dealt, name)
    return table.withColumns({"_range": F.shiftright("_place", PLACE_BITS), "_at": F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}).drop("_place")


def before_ranges(table: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """`_range` and, under each name, what the aggregate sums up to over all ranges before it; one row a range, to be sent out."""
    own = table.groupBy("_range").agg(*[c.alias(n) for n, c in totals.items()]).orderBy("_range").collect()
    kinds = table.groupBy("_range").agg(*[c.alias(n) for n, c in totals.items()]).schema
    sums = {n: [0, *itertools.accumulate(r[n] or 0 for r in own)] for n in totals}
    rows = [(r["_range"], *[type(r[n] or 0)(sums[n][i]) for n in totals]) for i, r in enumerate(own)]
    return F.broadcast(table.sparkSession.createDataFrame(rows, kinds))


def numbered(rows: DataFrame, order: list[Column], number: str = "n") -> DataFrame:
    """rows with their number in the order, from 1."""
    table = ranged(rows, order)
    offsets = before_ranges(table, {"_before": F.count("*")})
    return table.join(offsets, "_range").withColumn(number, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def running_totals(rows: DataFrame, sums: dict[str, Column], order: list[Column]) -> DataFrame:
    """rows with, under each name, the sum of a Column over all rows up to this one in the order; nulls add nothing, no value yet is null."""
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    table = ranged(rows.withColumns(values), order)
    totals = {f"_b{i}": F.sum(f"_v{i}") for i in range(len(sums))} | {f"_s{i}": F.count(f"_v{i}") for i in range(len(sums))}
    offsets = before_ranges(table, totals)
    w = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = table.join(offsets, "_range")
    out = {}
    for i, name in enumerate(sums):
        here = F.sum(f"_v{i}").over(w)
        out[name] = F.when(here.isNotNull() | (F.col(f"_s{i}") > 0), F.coalesce(here, F.lit(0)) + F.coalesce(f"_b{i}", F.lit(0)))
    return own.withColumns(out).drop("_range", "_at", *values, *totals)
