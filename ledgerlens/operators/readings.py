"""Readings of page images: lines of a reader's output, the best of several readings, and pages that a second reader sees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import candidate_score, is_empty, is_meaningful, kind_of_name, strip
from ledgerlens.sources.tables import written

LINE = "struct<text:string,score:double>"
# Readers by name, the one that stands in for others, and the reader and mode of each kind of document.
READERS = ("easyocr", "paddleocr", "rapidocr")
DEFAULT_READER = "easyocr"
READER_OF_KIND = {"native_pdf": "easyocr", "scanned_blurry_pdf": "paddleocr", "image_photo": "paddleocr", "image_handwritten": "paddleocr"}
MODE_OF_KIND = {"scanned_blurry_pdf": "ocr_only", "native_pdf": "auto"}


def _line(text: Column, score: Column) -> Column:
    """A line of two variants; its score is null unless a number."""
    number = F.schema_of_variant(score).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")
    return F.struct(strip(F.try_variant_get(text, "$", "string")).alias("text"), F.when(number, F.try_variant_get(score, "$", "double")).alias("score")).cast(LINE)


def _listed(block: Column) -> Column:
    """Lines of an object with rec_texts and rec_scores."""
    scores = F.try_variant_get(block, "$.rec_scores", "array<variant>")
    return F.transform(F.try_variant_get(block, "$.rec_texts", "array<variant>"), lambda x, i: _line(x, F.get(scores, i)))


def _boxed(block: Column) -> Column:
    """Lines of a list of [box, [text, score]] or [box, text]."""
    part = lambda x, p: F.try_variant_get(x, p, "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(part(x, "$[1]")), F.lit(""))
    pair = lambda x: _line(part(x, "$[1][0]"), part(x, "$[1][1]"))
    plain = lambda x: _line(part(x, "$[1]"), F.lit(None).cast("variant"))
    return F.transform(F.try_variant_get(block, "$", "array<variant>"), lambda x: F.when(kind(x).startswith("ARRAY"), pair(x)).when(kind(x) == "STRING", plain(x)))


def lines_of(output: Column) -> Column:
    """array<struct<text, score>> of a reader's output as JSON: an object of texts and scores, or a list of such objects and of lists of boxes.

    Lines without text are left out, as is what has none of these forms; null or broken output has no lines.
    """
    v = F.try_parse_json(output)
    form = lambda x: F.coalesce(F.schema_of_variant(x), F.lit(""))
    none = F.array().cast(f"array<{LINE}>")
    blocks = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.coalesce(F.when(form(b).startswith("OBJECT"), _listed(b)).when(form(b).startswith("ARRAY"), _boxed(b)), none))
    found = F.when(form(v).startswith("OBJECT"), _listed(v)).when(form(v).startswith("ARRAY"), F.flatten(blocks))
    return F.filter(F.coalesce(found, none), lambda x: ~is_empty(x["text"]))


def reading_of(lines: Column) -> tuple[Column, Column]:
    """(text, confidences) of lines: their texts a line each, and the scores that there are."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n"), F.array_compact(F.transform(lines, lambda x: x["score"]))


def best_reading(readings: DataFrame, keys: list[str], text: str = "text", confidences: str = "confidences", order: str = "candidate") -> DataFrame:
    """keys, text and score of the reading of most signal and confidence, in a tie the first by ``order``.

    Where no score is above 0 the text is empty. A null text counts as empty, null confidences as none.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    scored = readings.select(*keys, own.alias("_t"), candidate_score(own, F.col(confidences)).alias("_s"), F.col(order).alias("_o"))
    best = scored.groupBy(*keys).agg(F.min_by(F.struct("_t", "_s"), F.struct((-F.col("_s")).alias("a"), F.col("_o").alias("b"))).alias("_b"))
    return best.select(*keys, F.when(F.col("_b._s") > 0, F.col("_b._t")).otherwise("").alias("text"), F.col("_b._s").alias("score"))


def largest_images(images: DataFrame, keys: list[str], content: str = "content", position: str = "position") -> DataFrame:
    """Of each page's images the largest, in a tie the first by position; pages whose images are all empty have none.

    Only lengths and positions are compared in the shuffle; the images themselves are joined back.
    """
    sized = images.withColumn("_n", F.coalesce(F.octet_length(F.col(content)), F.lit(0)))
    best = sized.where("_n > 0").groupBy(*keys).agg(F.min_by(position, F.struct((-F.col("_n")).alias("a"), F.col(position).alias("b"))).alias("_p"))
    own = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_p")
    same = reduce(lambda a, b: a & b, [sized[k].eqNullSafe(own[f"_{k}"]) for k in keys], sized[position] == own["_p"])
    return sized.join(own, same, "left_semi").drop("_n")


def page_texts(pages: DataFrame, first: str = "ocr", second: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds page_text and fell_back to rows of pages with a first reading.

    A meaningful first reading counts. Other pages, and they alone, are given to ``second``, a function of a DataFrame that
    adds ``seen``; without it whatever was read first stays.
    """
    read = F.coalesce(F.col(first), F.lit(""))
    if second is None:
        return pages.withColumns({"page_text": read, "fell_back": F.lit(False)})
    good = is_meaningful(read)
    fine = pages.where(good).withColumns({"page_text": read, "fell_back": F.lit(False)})
    # what the second reader says is written, so that it sees a page once
    again = written(second(pages.where(~good)), "seen-pages")
    return fine.unionByName(again.withColumns({"page_text": strip(F.coalesce("seen", F.lit(""))), "fell_back": F.lit(True)}).drop("seen"))


def document_texts(docs: DataFrame, pages: DataFrame, key: str, reader: str, second: str = "vision", page: str = "page") -> DataFrame:
    """key, text, n_pages, n_images, method of documents (key, n_pages) whose pages page_texts has read.

    Pages with text are put in order, a blank line between them. method: the reader, ``reader+second`` where pages fell
    back and anything was read, else the second alone, as for a document without images. Documents and pages are grouped
    together, so that texts are shuffled once; a join behind the grouping would shuffle and sort them again.
    """
    there = F.when(F.col("page_text") != "", F.struct(F.col(page).alias("p"), F.col("page_text").alias("t")))
    asked = docs.select(F.col(key).alias("_key"), F.struct("n_pages").alias("_doc"))
    read = pages.select(F.col(key).alias("_key"), F.struct(there.alias("there"), F.col("fell_back").alias("back")).alias("_read"))
    own = asked.unionByName(read, allowMissingColumns=True).groupBy("_key")
    j = own.agg(F.collect_list("_doc").alias("_docs"), F.array_sort(F.collect_list("_read.there")).alias("_all"), F.count("_read").alias("_images"), F.bool_or("_read.back").alias("_back"))
    text = strip(F.array_join(F.transform("_all", lambda x: x["t"]), "\n\n"))
    method = F.when(F.col("_images") == 0, second).when(~F.col("_back"), reader).when(F.size("_all") > 0, f"{reader}+{second}").otherwise(second)
    found = j.where(F.size("_docs") > 0).select(F.col("_key").cast(docs.schema[key].dataType).alias(key), text.alias("text"), F.col("_images").alias("n_images"), method.alias("method"), F.inline("_docs"))
    return found.select(key, "text", "n_pages", "n_images", "method")


def reader_named(name: str | None) -> str:
    own = (name or DEFAULT_READER).strip().lower()
    return own if own in READERS else DEFAULT_READER


def selected_reader(preferred: str | None, usable: set[str]) -> str:
    """The preferred reader if it can be used, else the default one if that can; if neither can, the preferred one's name."""
    name = reader_named(preferred)
    return next((n for n in (name, DEFAULT_READER) if n in usable), name)


def policy(name: Column, otherwise: str = DEFAULT_READER, mode: str = "auto", readers: dict[str, str] = READER_OF_KIND) -> Column:
    """struct<kind, reader, mode> of a file name: how a document of its kind is read; a column, so that no setting is changed for a while."""
    kind = kind_of_name(name)
    of = lambda table, default: F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind], F.lit(default))
    return F.struct(kind.alias("kind"), of({k: reader_named(v) for k, v in readers.items()}, reader_named(otherwise)).alias("reader"), of(MODE_OF_KIND, mode).alias("mode"))


def answered(rows: DataFrame, model: Callable, prompt: str = "prompt", images: str | None = None) -> DataFrame:
    """Adds answer and failed: what a model says to a batch of prompts, or to prompts and their images (array<binary>).

    A batch that fails is asked again row by row; a row that fails alone has a null answer and the error's name in
    ``failed``, so that it is a record of nulls to all that follows.
    """

    def one(prompts: list, seen: list | None) -> list:
        return list(model(prompts) if seen is None else model(prompts, seen))

    def all_of(prompts: pd.Series, seen: pd.Series | None) -> pd.DataFrame:
        p = prompts.fillna("").tolist()
        s = None if seen is None else [[] if x is None else list(x) for x in seen]
        try:
            said = [(a, None) for a in one(p, s)]
            if len(said) != len(p):
                raise ValueError("an answer for each prompt")
        except Exception:
            said = []
            for i, x in enumerate(p):
                try:
                    said.append((one([x], None if s is None else [s[i]])[0], None))
                except Exception as e:  # a row must not end the run
                    said.append((None, type(e).__name__))
        return pd.DataFrame(said, columns=["answer", "failed"], dtype=object)

    form = "struct<answer:string,failed:string>"
    got = _text_udf(all_of, form)(F.col(prompt)) if images is None else _image_udf(all_of, form)(F.col(prompt), F.col(images))
    return rows.withColumn("_said", got).withColumns({"answer": F.col("_said.answer"), "failed": F.col("_said.failed")}).drop("_said")


def _text_udf(all_of: Callable, form: str):
    @F.pandas_udf(form)
    def ask(prompts: pd.Series) -> pd.DataFrame:
        return all_of(prompts, None)

    return ask


def _image_udf(all_of: Callable, form: str):
    @F.pandas_udf(form)
    def ask(prompts: pd.Series, seen: pd.Series) -> pd.DataFrame:
        return all_of(prompts, seen)

    return ask
