"""Case files that are merged while their documents arrive: the state of each field is the best value so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.streaming.tables import latest, run_to_table, table_path

VALUES = ["_order", "value", "confidence", "has_detail"]


def best_of(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The row that a fold in order of documents ends with, of each key.

    A value beats none, a detail beats none, a confidence beats none and a higher one a lower one; among equals the earliest document
    stays. That is one order of all rows, so it doesn't matter in which order, or in how many batches, documents arrive.
    """
    plain = rows.assign(_none=rows["value"].isna(), _bare=~rows["has_detail"].astype(bool), _sure=-rows["confidence"].astype(float))
    ordered = plain.sort_values(["_none", "_bare", "_sure", "_order"], kind="stable", na_position="last")
    return ordered.drop_duplicates(keys)[rows.columns]


def merged_stream(rows: DataFrame, case: str = "case_id", order: str = "doc_index") -> DataFrame:
    """Changed (case, field, from_order, value, confidence) of a stream of (case, order, field, value, confidence[, has_detail]), for update mode.

    Every task first keeps the best row of each field of what it has read, so that a case with most of the documents sends a few; then
    each (case, field) holds one row of state. Rows without a case or field are the rows of case or field null. has_detail: true if absent.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    detail = F.coalesce(F.col("has_detail"), F.lit(False)) if "has_detail" in kinds else F.lit(True)
    long = rows.select(F.col(case).alias("_case"), F.col("field").alias("_field"), F.col(order).cast("long").alias("_order"), F.col("value").cast("string").alias("value"), F.col("confidence").cast("double").alias("confidence"), detail.alias("has_detail"))

    def thinned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield best_of(part, ["_case", "_field"])

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame([state.get], columns=VALUES) if state.exists else None
        old = None if kept is None else tuple(kept.iloc[0])
        for part in parts:
            own = part[VALUES].assign(_one=0)
            kept = best_of(own if kept is None else pd.concat([kept.assign(_one=0), own]).astype({"has_detail": bool}), ["_one"])[VALUES]
        order_, value, confidence, has_detail = kept.iloc[0]
        new = (None if pd.isna(order_) else int(order_), None if pd.isna(value) else str(value), None if pd.isna(confidence) else float(confidence), bool(has_detail))
        state.update(new)
        if new != old:
            yield pd.DataFrame({case: [key[0]], "field": [key[1]], f"from_{order}": pd.array([new[0]], dtype="Int64"), "value": [new[1]], "confidence": [new[2]]})

    schema = f"{case} {kinds[case]}, field string, from_{order} long, value string, confidence double"
    from pyspark.sql.streaming.state import GroupStateTimeout

    thin = long.mapInPandas(thinned, long.schema)
    return thin.groupBy("_case", "_field").applyInPandasWithState(fold, schema, "_order long, value string, confidence double, has_detail boolean", "update", GroupStateTimeout.NoTimeout)


def merge_arrived(spark: SparkSession, rows: DataFrame, case: str = "case_id", order: str = "doc_index", path: str | None = None) -> DataFrame:
    """Folds all that has arrived of a stream into the table at ``path`` (a new one by default) and returns the merged cases as they are now."""
    path = path or table_path(spark, "cases")
    changes = merged_stream(rows, case, order)
    run_to_table(changes, path)
    return latest(spark, path, [case, "field"], changes.schema)
