"""Case files: several documents' fields merged into one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.plans.schema import Schema


def merge_fields(rows: DataFrame, case: str = "case_id", order: str = "doc_index") -> DataFrame:
    """One row for each (case, field) of long rows (case, order, field, value, confidence).

    The first value that is not null stays until one of strictly higher confidence comes, or one with
    a confidence where the kept one has none. Nulls never replace; equal confidences keep the earlier.
    With all values null the first row stays.
    """
    w = Window.partitionBy(case, "field").orderBy(F.col("value").isNull(), F.col("confidence").desc_nulls_last(), order)
    out = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return out.withColumnRenamed(order, f"from_{order}")


def fold_fields(rows: DataFrame, case: str = "case_id", order: str = "doc_index") -> DataFrame:
    """The same for rows of which some values have no detail at all (has_detail false): any detail beats none.

    Documents of a case are folded in order, which such rows need; a case's documents are few.
    """
    docs = rows.groupBy(case, "field").agg(F.array_sort(F.collect_list(F.struct(order, "value", "confidence", "has_detail"))).alias("log"))

    def step(kept, x):
        better = (x["value"].isNotNull()) & (
            kept["value"].isNull()
            | (~kept["has_detail"] & x["has_detail"])
            | (kept["has_detail"] & x["has_detail"] & x["confidence"].isNotNull() & (kept["confidence"].isNull() | (x["confidence"] > kept["confidence"])))
        )
        return F.when(F.coalesce(better, F.lit(False)), x).otherwise(kept)

    first = F.get(F.col("log"), F.lit(0))
    return docs.withColumn("kept", F.aggregate(F.slice("log", F.lit(2), F.size("log")), first, step)).select(case, "field", F.col(f"kept.{order}").alias(f"from_{order}"), "kept.value", "kept.confidence")


def present_types(rows: DataFrame, case: str = "case_id", order: str = "doc_index", kind: str = "document_type") -> DataFrame:
    """Distinct document types of each case in order of appearance."""
    own = rows.where(F.col(kind).isNotNull()).groupBy(case).agg(F.array_sort(F.collect_list(F.struct(order, kind))).alias("t"))
    return own.select(case, F.array_distinct(F.transform("t", lambda x: x[kind])).alias("types"))


def fill_missing(rows: DataFrame, schema: Schema, case: str = "case_id") -> DataFrame:
    """Adds a null row for each field of the schema that a case lacks."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(f.name, i) for i, f in enumerate(schema.fields)], "field string, ordinal int")
    every = rows.select(case).distinct().join(F.broadcast(names))
    return every.join(rows, [case, "field"], "left")


def widen(rows: DataFrame, schema: Schema, case: str = "case_id") -> DataFrame:
    """Long rows (case, field, value) as one record a case, with the schema's fields as text columns."""
    return rows.groupBy(case).pivot("field", [f.name for f in schema.fields]).agg(F.first("value"))


def lengthen(records: DataFrame, schema: Schema, keys: list[str]) -> DataFrame:
    """Records as long rows keys, ordinal, field, value, number, status (`ok` or `empty`), in schema order."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    rows = []
    for i, f in enumerate(schema.fields):
        c = F.col(f.name) if f.name in kinds else F.lit(None).cast("string")
        number = c.cast("double") if kinds.get(f.name) in ("double", "bigint", "int", "float") else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("field"), c.cast("string").alias("value"), number.alias("number")))
    out = records.select(*keys, F.inline(F.array(*rows)))
    return out.withColumn("status", F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty").otherwise("ok"))


def match_keys(predicted: DataFrame, names: DataFrame, key: str = "field") -> DataFrame:
    """Maps predicted keys to schema names: the exact one, else the one equal but for case and signs; unmatched ones go."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = predicted.withColumn("_plain", plain(F.col(key)))
    b = names.select(F.col("field").alias("_name"), plain(F.col("field")).alias("_plain"))
    cols = [c for c in predicted.columns if c != key]
    j = a.join(F.broadcast(b), "_plain").withColumn("_exact", F.col(key) == F.col("_name"))
    w = Window.partitionBy(*[c for c in cols if c not in ("value", "number", "confidence")], "_name").orderBy(F.desc("_exact"), key)
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("_name").alias(key), *cols)
