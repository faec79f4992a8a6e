"""Tables whose rows are counted while they are written, and guarded calls whose failures are rows of their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.sources.store import _fs


class WrongCount(ValueError):
    """A written table had other numbers of rows than it should; it is gone again."""


def write_counted(rows: DataFrame, path: str, expected: dict[str, int], by: str, *, partition_by: list[str] = ()) -> dict[str, int]:
    """Writes rows as Parquet and returns how many each value of ``by`` had; fails, and takes the table back, if they are not as expected.

    The counts are gathered by the tasks that write, so the input is read once. expected: rows by value of ``by``, such as files or
    runs; they are few, as each is one figure. Values that are not expected, null among them, fail as well.
    """
    seen = Observation("rows")
    counts = [F.count_if(F.col(by) == value).alias(f"n{i}") for i, value in enumerate(expected)]
    watched = rows.observe(seen, F.count("*").alias("all"), *counts)
    watched.write.partitionBy(*partition_by).parquet(path) if partition_by else watched.write.parquet(path)
    got = seen.get
    found = {value: got[f"n{i}"] for i, value in enumerate(expected)}
    wrong = [f"{value}: {found[value]} rows for {n}" for value, n in expected.items() if found[value] != n]
    if got["all"] != sum(found.values()):
        wrong.append(f"{got['all'] - sum(found.values())} rows of others")
    if wrong:
        fs, folder = _fs(rows.sparkSession, path)
        fs.delete(folder, True)
        raise WrongCount("; ".join(wrong))
    return found


def guarded(rows: DataFrame, column: str, call: Callable, *, answer: str = "answer", seconds: float = 240.0) -> DataFrame:
    """Adds ``answer`` (text) and ``failure``: what ``call`` says of a column's value, or null and why it said nothing.

    Each row has a budget of seconds: a call that is not back by then is left behind, in a thread of its own, and its row fails with `timeout`;
    one that raises fails with the error's name and text. Null values are not asked. Nothing that a row does fails the task.
    """

    @F.pandas_udf(f"{answer} string, failure string")
    def ask(values: pd.Series) -> pd.DataFrame:
        import threading

        def one(value):
            if value is None or value is pd.NA:
                return None, None
            box = {}

            def work():
                try:
                    box["answer"] = call(value)
                except Exception as e:  # noqa: BLE001  every failure of a provider is a row
                    box["failure"] = f"{type(e).__name__}: {e}"

            thread = threading.Thread(target=work, daemon=True)
            thread.start()
            thread.join(seconds)
            if not box:
                return None, "timeout"
            said = box.get("answer")
            return None if said is None else str(said), box.get("failure")

        return pd.DataFrame([one(v) for v in values], columns=[answer, "failure"], dtype=object)

    return rows.withColumn("_said", ask(F.col(column))).select("*", f"_said.{answer}", "_said.failure").drop("_said")


def with_dead_letters(rows: DataFrame, path: str, column: str, call: Callable, *, answer: str = "answer", seconds: float = 240.0) -> tuple[DataFrame, DataFrame]:
    """(answered, dead): guarded rows as a table at ``path``, so that each is asked once, split into those without and with a failure."""
    guarded(rows, column, call, answer=answer, seconds=seconds).write.parquet(path)
    done = rows.sparkSession.read.parquet(path)
    return done.where(F.col("failure").isNull()), done.where(F.col("failure").isNotNull())


def ask_again(dead: DataFrame, path: str, column: str, call: Callable, *, answer: str = "answer", seconds: float = 240.0) -> tuple[DataFrame, DataFrame]:
    """The same for the failed rows of an earlier round alone."""
    return with_dead_letters(dead.drop(answer, "failure"), path, column, call, answer=answer, seconds=seconds)
