"""Importance resampling of documents towards a target corpus, over hashed n-gram buckets.

Both corpora are inverted: a posting list names a bucket, a block of documents, and the places in
the block of the documents that have the bucket, each with its count. Lists are shuffled by their
bucket, and lists of a bucket that many blocks have are salted. Where a bucket's lists of both
corpora meet, its gain follows from its two counts and the corpora's sizes; each list adds its gain times
its counts to the documents of its block, and the sums come back together by block. Documents are drawn without
replacement by adding Gumbel noise that depends on their id alone, so that a rerun draws the same.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written
from ledgerlens.operators.ranges import numbered

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of texts and documents that one block has at most (a longer text is a block of its own).
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 16_384
#: Blocks whose lists of a bucket go together; more are salted.
SALTED_BLOCKS = 512
#: Bytes that part words (all ASCII but digits and letters become a space) and capitals in lower case. Words go on over all bytes beyond ASCII.
FOLD = bytes(b if b > 0x7F or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))

POSTINGS = "block long, bucket int, docs array<int>, counts array<int>, n long, ids array<{kind}>, words array<long>, features array<long>"


class Buckets(dict):
    """word or run -> its bucket; the memory is emptied when it has grown."""

    def __init__(self, n: int, most: int = 1 << 20):
        self.n, self.most = n, most

    def __missing__(self, run: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[run] = zlib.crc32(run) % self.n
        return out


def runs_of(words: list[bytes], longest: int) -> list[bytes]:
    out = list(words)
    for n in range(2, longest + 1):
        out += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return out


def inverted(docs: DataFrame, *, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Posting lists of ``docs`` (POSTINGS), and for each block one row with bucket -1: ids, words and features of its documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = POSTINGS.format(kind=kind)

    def invert(parts):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        of, task, made = Buckets(buckets), TaskContext.get().partitionId(), 0
        id_type = to_arrow_type(docs_type)

        def block(ids, words, found):
            number = task << 33 | made
            n = len(ids)
            lengths = np.fromiter(map(len, found), np.int64, n)
            key = np.concatenate(found).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
            key, counts = np.unique(key, return_counts=True)
            bucket, doc = np.divmod(key, max(n, 1))
            own, first = np.unique(bucket, return_index=True)
            edges = np.concatenate((first, [len(key)], [len(key)])).astype(np.int32)
            totals = np.add.reduceat(counts, first) if len(own) else counts[:0]
            rows = len(own) + 1
            last = np.concatenate((np.zeros(rows, np.int32), [n])).astype(np.int32)  # the lists of documents stand in the last row alone
            lists = lambda v, k: pa.ListArray.from_arrays(pa.array(edges), pa.array(v, k))
            about = lambda v: pa.ListArray.from_arrays(pa.array(last), v)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, number), pa.int64()),
                    pa.array(np.append(own, -1), pa.int32()),
                    lists(doc, pa.int32()),
                    lists(counts, pa.int32()),
                    pa.array(np.append(totals, lengths.sum()), pa.int64()),
                    about(pa.array(ids, id_type)),
                    about(pa.array(words, pa.int64())),
                    about(pa.array(lengths)),
                ],
                names=["block", "bucket", "docs", "counts", "n", "ids", "words", "features"],
            )

        ids, words, found, held = [], [], [], 0
        for batch in parts:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py() or b""
                if ids and (held + len(data) > BLOCK_BYTES or len(ids) == BLOCK_ROWS):
                    yield block(ids, words, found)
                    ids, words, found, held, made = [], [], [], 0, made + 1
                own = data.translate(FOLD).split()
                runs = own if longest == 1 else runs_of(own, longest)
                ids.append(key.as_py())
                words.append(len(own))
                found.append(np.fromiter((of[w] for w in runs), np.int32, len(runs)))
                held += len(data)
        if ids:
            yield block(ids, words, found)

    docs_type = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(invert, schema)


def gain(s: Column, t: Column, source_size: int, target_size: int, buckets: int) -> Column:
    """A thousandth of a nat is 1: how much likelier a bucket is in the target than in the source, both smoothed by one; in doubles."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.log((d(t) + 1) * F.lit(float(source_size + buckets)) / ((d(s) + 1) * F.lit(float(target_size + buckets)))))


def contributions(lists: DataFrame) -> DataFrame:
    """block and the sums of gain times count by place in the block, from posting lists with their gain.

    Lists come sorted by block, so that a task holds the sums of one block at a time; places without a posting here are left out.
    """

    def add(parts):
        import numpy as np
        import pyarrow as pa

        def given(block, docs, sums):
            at, place = np.unique(np.concatenate(docs), return_inverse=True)
            total = np.zeros(len(at), np.int64)
            np.add.at(total, place, np.concatenate(sums))
            one = pa.array(np.array([0, len(at)], np.int32))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(one, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(one, pa.array(total))], names=["block", "docs", "sums"])

        now, docs, sums = None, [], []
        for batch in parts:
            blocks, gains = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for i, block in enumerate(blocks.tolist()):
                if block != now and docs:
                    yield given(now, docs, sums)
                    docs, sums = [], []
                now = block
                docs.append(batch.column(1)[i].values.to_numpy())
                sums.append(batch.column(2)[i].values.to_numpy().astype(np.int64) * gains[i])
        if docs:
            yield given(now, docs, sums)

    return lists.select("block", "docs", "counts", "gain").mapInArrow(add, "block long, docs array<int>, sums array<long>")


def weighted(about: DataFrame, sums: DataFrame, kind: str) -> DataFrame:
    """_id, n_words, n_features and weight of each document: its block's sums from all tasks, added by place, over its features, rounded down."""
    schema = f"_id {kind}, n_words long, n_features long, weight long"
    both = about.select("block", F.lit(0).alias("_kind"), "ids", "words", "features", F.lit(None).cast("array<int>").alias("docs"), F.lit(None).cast("array<long>").alias("sums")).unionByName(
        sums.select("block", F.lit(1).alias("_kind"), F.lit(None).cast(about.schema["ids"].dataType).alias("ids"), *[F.lit(None).cast("array<long>").alias(c) for c in ("words", "features")], "docs", "sums")
    )
    dealt = both.repartition("block").sortWithinPartitions("block", "_kind")

    def reduce(parts):
        import numpy as np
        import pyarrow as pa

        def given(ids, words, features, total):
            weight = np.where(features > 0, np.floor_divide(total, np.maximum(features, 1)), 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(features), pa.array(weight)], names=["_id", "n_words", "n_features", "weight"])

        head = None
        for batch in parts:
            kinds = batch.column(1).to_pylist()
            for i, which in enumerate(kinds):
                if which == 0:  # each block begins with its row of documents
                    if head:
                        yield given(*head)
                    ids = batch.column(2)[i].values
                    head = (ids, batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy(), np.zeros(len(ids), np.int64))
                else:
                    np.add.at(head[3], batch.column(5)[i].values.to_numpy(), batch.column(6)[i].values.to_numpy())
        if head:
            yield given(*head)

    return dealt.mapInArrow(reduce, schema)


def importance(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """id_col, n_words, n_features and weight of each row of ``docs``; see ``resample``."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    own = written(inverted(docs, id_col=id_col, text_col=text_col, buckets=buckets, longest=longest), "postings")
    other = written(inverted(target.select(F.lit(0).alias("_id"), F.col(target_text_col).alias("_text")), id_col="_id", text_col="_text", buckets=buckets, longest=longest), "postings")
    about, lists = own.where("bucket < 0"), own.where("bucket >= 0")
    n_blocks, source_size = about.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    target_size = other.where("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = max(1, -(-n_blocks // SALTED_BLOCKS))
    # Both corpora's counts meet by bucket; a gain is worked out once and goes to each salt of its bucket.
    counted = lists.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(other.where("bucket >= 0").select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    gains = counted.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).select("bucket", gain(F.col("s"), F.col("t"), source_size, target_size, buckets).alias("gain"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    met = salted.join(gains.hint("shuffle_hash"), ["bucket", "salt"]).sortWithinPartitions("block")
    return weighted(about, contributions(met), kind).withColumnRenamed("_id", id_col)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, of an id and a seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_features, weight, score and rank, all but the id long.

    Features are the runs of 1 to ``longest`` words, repeats counted; weight is the mean gain of their buckets, rounded
    down (without features 0), score the weight plus noise of the id. Of the rows with ``least_words`` words at least, ``percent`` in
    a hundred, rounded down, are drawn by highest score, ties to the smaller id, and numbered from 1; rank is null for all others.
    A null text has no words. A null id counts as an empty string in the noise and comes last among ties. Repeated rows are documents of their
    own. Without documents the result is empty, without a target all counts in it are zero.
    """
    found = importance(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, buckets=buckets, longest=longest)
    # The table is read twice, and equal rows are told apart by their place in it.
    scored = written(found.withColumns({"score": F.col("weight") + noise(F.col(id_col), seed), "_tie": F.monotonically_increasing_id()}), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("_tie")]
    drawn = numbered(scored.where(able), order, "rank").withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).drop("_tie")
