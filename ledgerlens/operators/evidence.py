"""Evidence of extracted fields: for each field the piece of its own document that is nearest to what the field asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import chunk_rows
from ledgerlens.operators.retrieve import euclidean
from ledgerlens.plans.schema import Schema
from ledgerlens.sources.providers import embed


def question(label: str, value: Column) -> Column:
    """What a field asks: its label, and the value that was read, if it is no blank text."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), value)).otherwise(F.lit(label))


def questions_of(records: DataFrame, schema: Schema, keys: list[str]) -> DataFrame:
    """keys, field and question of every field of the schema; records have the fields as text columns."""
    asked = [F.struct(F.lit(f.name).alias("field"), question(f.label or f.name, F.col(f.name).cast("string")).alias("question")) for f in schema.fields]
    return records.select(*keys, F.inline(F.array(*asked)))


def pieces_of(docs: DataFrame, keys: list[str], text_col: str = "text", pages_col: str | None = None) -> DataFrame:
    """keys, id, text, page and position of the chunks of each document, of its pages (array<string>, numbered from 1) where it has them."""
    if pages_col is None:
        own = chunk_rows(F.col(text_col))
    else:
        by_page = F.flatten(F.transform(F.col(pages_col), lambda p, i: chunk_rows(p, i + 1)))
        own = F.when(F.size(F.coalesce(F.col(pages_col), F.array().cast("array<string>"))) > 0, by_page).otherwise(chunk_rows(F.col(text_col)))
    return docs.select(*keys, F.posexplode(own).alias("position", "_c")).select(*keys, "position", "_c.id", "_c.text", "_c.page")


def best_pieces(questions: DataFrame, pieces: DataFrame, vectors: Callable[[list[str]], list[list[float]]], keys: list[str], k: int = 1) -> DataFrame:
    """keys, field, rank, id, text, page, distance: the k pieces of a question's own document that are nearest to it.

    A join on the document's keys (nulls are a key), so that a question meets the pieces of one document and no others; ties go to the earlier
    piece. Blank questions and documents without a piece have no evidence; what has no finite vector is nobody's.
    """
    q = embed(questions.where(F.trim(F.coalesce("question", F.lit(""))) != "").select(*[F.col(c).alias(f"_q{i}") for i, c in enumerate(keys)], "field", "question"), vectors, "question").drop("question").withColumnRenamed("vector", "_qv")
    p = embed(pieces, vectors, "text")
    same = [p[c].eqNullSafe(q[f"_q{i}"]) for i, c in enumerate(keys)]
    met = p.join(q, same).withColumn("distance", euclidean(F.col("_qv"), F.col("vector"))).where(F.col("distance") < float("inf"))
    w = Window.partitionBy(*keys, "field").orderBy("distance", "position")
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))
    return ranked.select(*keys, "field", "rank", "id", "text", "page", "distance")


def with_evidence(records: DataFrame, schema: Schema, vectors: Callable[[list[str]], list[list[float]]], keys: list[str], *, text_col: str = "text", pages_col: str | None = None) -> DataFrame:
    """records with evidence and page of their details replaced by the nearest piece of the document; keys must tell records apart.

    Every detail that is there keeps its confidence; a piece without a page, as of a text without pages, leaves the page as it was.
    """
    found = best_pieces(questions_of(records, schema, keys), pieces_of(records, keys, text_col, pages_col), vectors, keys)
    by_record = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("text", "page")))).alias("_evidence"))  # a record's fields are few
    by_record = by_record.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_evidence")
    out = records.join(by_record, [records[c].eqNullSafe(by_record[f"_k{i}"]) for i, c in enumerate(keys)], "left")
    seen = F.col("_evidence")

    def told(name: Column, detail: Column) -> Column:
        return F.when(
            seen.isNotNull() & seen[name].isNotNull(),
            F.struct(detail["confidence"].alias("confidence"), seen[name]["text"].alias("evidence"), F.when(seen[name]["page"] > 0, seen[name]["page"]).otherwise(detail["page"]).alias("page")),
        ).otherwise(detail)

    return out.withColumn("details", F.transform_values("details", told)).select(*records.columns)
