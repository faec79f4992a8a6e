"""Shared pieces: the shared scratch folder, written intermediate tables, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters outside a "plain" word: all ASCII but digits and letters.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A "plain" word: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A white-space separated word.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent (tests, a single machine) a temporary folder is
    made once and put into the session's setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that a table may have, as reckoned from its rows, to be sent to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def sendable(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table with the broadcast hint if the sum of row_bytes over all its rows is within the limit, else as it is."""
    total = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the bytewise lower()."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def plain_words(text: Column) -> Column:
    """Lower-cased plain words in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """Each row as a struct ``row`` beside the named columns, so that no column of docs can clash with another table's."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, *[c.alias(n) for n, c in named.items()])


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine, chunk: int = 64) -> Column:
    """combine of each element of an array (none of them null) with all before it.

    Pieces of ``chunk`` elements are folded apart and what stands before each piece is carried in, so that no
    array grows element by element: a long array costs its length times the chunk, not its square.
    """

    def fold(a: Column) -> Column:
        return F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), combine)

    def pieces(a: Column) -> Column:
        last = F.greatest(F.ceil(F.size(a) / chunk).cast("int") - 1, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * chunk + 1, F.lit(chunk)))
        return F.transform(cut, lambda p: F.transform(p, lambda x, i: fold(F.slice(p, F.lit(1), i + 1))))

    def carried(own: Column) -> Column:
        ends = F.transform(own, lambda p: F.element_at(p, -1))
        before = let(ends, lambda e: F.transform(e, lambda x, c: fold(F.slice(e, F.lit(1), c))))
        return F.zip_with(own, before, lambda p, b: F.when(b.isNull(), p).otherwise(F.transform(p, lambda x: combine(b, x))))

    return let(values, lambda a: F.when(F.size(a) > 0, F.flatten(let(pieces(a), carried))).otherwise(a))


def cut(text: Column, spans: Column, group: int = 64) -> Column:
    """The pieces [start, end) of a text; spans: array<struct<start,end>> in code points, sorted and disjoint.

    The text is gone through from its beginning once for each ``group`` spans, not once for each.
    """

    def pieces(own: Column) -> Column:
        base = F.get(own, F.lit(0))["start"]
        part = F.substring(text, base + 1, F.get(own, F.size(own) - 1)["end"] - base)
        return let(part, lambda t: F.transform(own, lambda x: F.substring(t, x["start"] - base + 1, x["end"] - x["start"])))

    last = lambda a: F.greatest(F.ceil(F.size(a) / group).cast("int") - 1, F.lit(0))
    return let(spans, lambda a: F.flatten(F.transform(F.sequence(F.lit(0), last(a)), lambda c: pieces(F.slice(a, c * group + 1, F.lit(group))))))
