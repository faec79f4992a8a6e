"""Providers of text, fields and vectors. Models and OCR engines plug in here; the defaults are deterministic.

A provider of text is a function of a batch of bytes. A reader cascade tries providers in turn: each sees
only the documents that the ones before it left without meaningful text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import is_meaningful
from ledgerlens.sources.tables import written

MODES = {"auto": ("embedded", "ocr", "vision"), "pypdf_only": ("embedded",), "ocr_only": ("ocr",), "vlm_only": ("vision",)}


@dataclass(frozen=True)
class TextProvider:
    name: str
    read: Callable[[bytes], str]


def utf8(content: bytes) -> str:
    """The default: what can be decoded is the text."""
    return bytes(content).decode("utf-8", errors="ignore")


def _reader(p: TextProvider):
    @F.pandas_udf("struct<text:string,method:string>")
    def read(batch: pd.Series) -> pd.DataFrame:
        out = []
        for b in batch:
            try:
                out.append((p.read(b) or "", p.name))
            except Exception:  # a document must not end the run: the marker says which reader failed
                out.append(("", f"{p.name}_failed"))
        return pd.DataFrame(out, columns=["text", "method"])

    return read


def read_texts(docs: DataFrame, providers: list[TextProvider], mode: str = "auto", content: str = "content") -> DataFrame:
    """Adds text and method. A reader that fails gives an empty text and the method ``<name>_failed``."""
    order = MODES.get(mode, MODES["auto"])
    own = sorted((p for p in providers if p.name in order), key=lambda p: order.index(p.name))
    left = docs.withColumns({"text": F.lit(""), "method": F.lit("none")})
    done = None
    for p in own:
        # each reader's texts are written, so that it sees a document once, whatever is asked of the result
        tried = left.withColumn("_r", _reader(p)(F.col(content))).withColumns({"text": F.col("_r.text"), "method": F.col("_r.method")}).drop("_r")
        tried = written(tried, f"read-{p.name}")
        good = tried.where(is_meaningful(F.col("text")))
        done = good if done is None else done.unionByName(good)
        left = tried.where(~is_meaningful(F.col("text")))
    return left if done is None else done.unionByName(left)


def embed(rows: DataFrame, vectors: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """Adds ``vector`` by an embedding function of a batch of texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(vectors(texts.fillna("").tolist()))

    return rows.withColumn("vector", of(F.col(text)))


@dataclass(frozen=True)
class Options:
    """What matters to results. reading_mode: the first valid one of the given, else auto."""

    reading_mode: str = "auto"
    redact: bool = False
    tolerance: float = 0.01
    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 3

    @staticmethod
    def mode(*given: str | None) -> str:
        return next((g for g in given if g in MODES), "auto")
