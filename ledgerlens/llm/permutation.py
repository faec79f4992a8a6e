"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of a bounded sample. A vector is represented by its nearest pivots in order.
The index is kept in shards, the Arrow batches of the table of permutations; in a shard each pivot's
inverted file posts the vectors that have it among their nearest, with its rank. A query looks up
its own pivots, which are few of all, adds up what the footrule distance of the two orders saves over the posts, and
reranks by the exact distance those that it met, in steps, nearest by footrule first, until some steps running bring no
nearer vector. Vectors that share no pivot with the query are never looked at, nor are those beyond the steps.
Shards return their nearest alone. Posts are added up inside a shard: a join of posts by pivot would write a
row for each pair of a dense group.

Queries are taken in blocks of bounded size, one after another, each held against all shards; a block's result is written
before the next begins, so neither the plan nor what is sent out grows with the number of queries.

Equal vectors are one class with one post, and of a class the smallest ids, as many as a result can hold,
stand for it: others can't be among a query's nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch_path, written

#: A class is named by its smallest id and the hash of its vector, as an id may stand by several vectors.
FOUND = "q long, q_tag long, class_id long, tag long, score double"

#: Pivots, a bounded sample of the vectors, and how many of them a permutation holds.
PIVOTS, PREFIX = 2048, 64
#: Share of a shard that a query reranks in one step, and the least number. Recall grows with both.
RERANK_SHARE, LEAST_RERANK = 0.01, 50
#: Steps in a row without a nearer vector that end the reranking.
IDLE_STEPS = 3
#: Queries of one block: about 12 MB to send out.
BLOCK = 16_384


def usable(v):
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _permutations(rows: DataFrame, pivots, prefix: int) -> DataFrame:
    """(class_id, tag, vector, near array<int>): each class's nearest pivots, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        p = shared.value
        norms = (p * p).sum(axis=1)
        for batch in parts:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            near = np.empty((len(v), prefix), dtype=np.int32)
            for at in range(0, len(v), 2048):
                d = norms - 2 * v[at : at + 2048] @ p.T
                first = np.argpartition(d, prefix - 1, axis=1)[:, :prefix]
                order = np.lexsort((first, np.take_along_axis(d, first, axis=1)), axis=1)
                near[at : at + 2048] = np.take_along_axis(first, order, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, prefix), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column, lists], names=["class_id", "tag", "vector", "near"])

    return rows.select("class_id", "tag", "vector").mapInArrow(batches, "class_id long, tag long, vector array<double>, near array<int>")


def _search_shard(ids, vectors, near, q_vectors, q_near, pivots: int, k: int, share: float, least: int, reached: list):
    """Arrays (query, row, distance), by place, of the k nearest found in one shard for each query; ties go to the smaller of ids.

    reached gets, for each query, the vectors that it met in the posts, those it reranked, and those of the shard.
    """
    import numpy as np

    n, prefix = near.shape
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    posts = (order // prefix).astype(np.int32)
    gains = (prefix - order % prefix).astype(np.int32)  # what a shared pivot saves is twice the smaller of both gains
    edges = np.searchsorted(flat[order], np.arange(pivots + 1))
    depth = max(least, k, int(np.ceil(share * n)))
    found = ([], [], [])
    for q in range(len(q_near)):
        lists = [slice(edges[p], edges[p + 1]) for p in q_near[q]]
        met = np.concatenate([posts[x] for x in lists])
        saved = np.bincount(met, np.concatenate([np.minimum(gains[x], prefix - rank) for rank, x in enumerate(lists)]), minlength=n)
        ranked = np.flatnonzero(saved)
        ranked = ranked[np.argsort(-saved[ranked], kind="stable")]
        rows, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        idle = 0
        for at in range(0, len(ranked), depth):
            some = ranked[at : at + depth]
            d = np.sqrt(((vectors[some] - q_vectors[q]) ** 2).sum(axis=1))
            every, all_d = np.concatenate([rows, some]), np.concatenate([best, d])
            keep = np.lexsort((ids[every], all_d))[:k]
            idle = idle + 1 if len(best) == k and (keep < k).all() else 0
            rows, best = every[keep], all_d[keep]
            if idle == IDLE_STEPS:
                break
        reached.append((len(ranked), min(len(ranked), at + depth) if len(ranked) else 0, n))
        found[0].append(np.full(len(best), q))
        found[1].append(rows)
        found[2].append(best)
    return [np.concatenate(x) for x in found]


def _search_block(near: DataFrame, asking, pivots: int, k: int, share: float, least: int, path: str) -> None:
    """Writes FOUND, each shard's nearest classes of the queries ``asking`` (class_id, tag, vector, near)."""
    import numpy as np

    names = (asking["class_id"].to_numpy(), asking["tag"].to_numpy())
    block = (names, np.stack(asking["vector"].to_numpy()).astype(np.float64), np.stack(asking["near"].to_numpy()).astype(np.int32))
    shared = near.sparkSession.sparkContext.broadcast(block)

    def batches(parts):
        import pyarrow as pa

        (q_ids, q_tags), q_vectors, q_near = shared.value
        for batch in parts:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), dtype=t).reshape(batch.num_rows, -1) for i, t in ((2, np.float64), (3, np.int32))]
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            q, row, score = _search_shard(ids, *rows, q_vectors, q_near, pivots, k, share, least, [])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[q], q_tags[q], ids[row], tags[row], score)], names=["q", "q_tag", "class_id", "tag", "score"])

    near.select("class_id", "tag", "vector", "near").mapInArrow(batches, FOUND).write.mode("append").parquet(path)
    shared.destroy()


def search(vectors: DataFrame, is_query, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", prefix: int = PREFIX, pivots: int = PIVOTS, share: float = RERANK_SHARE, least: int = LEAST_RERANK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row that ``is_query`` names.

    Distances are Euclidean, in double precision, of the given vectors; ties go to the smaller id. Rows
    whose id is null, whose vector is not usable, or whose length is not the most frequent one (the
    shorter, in a tie) take no part. Of rows with equal ids and vectors one counts; another vector under the query's own
    id is a candidate like any other. An empty table
    gives an empty result; queries without any other row have none.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    length = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == length["d"])
    # the smallest ids of each class, cut down before the shuffle; rows that repeat an id share its rank
    ranked = rows.select("id", "vector").withColumn("r", F.dense_rank().over(Window.partitionBy("vector").orderBy("id")))
    members = ranked.where(F.col("r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = written(members.select(F.element_at("ids", 1).alias("class_id"), F.xxhash64("vector").alias("tag"), "vector", "ids"), "classes")
    picked = classes.select("vector", F.xxhash64("class_id").alias("h"), "class_id").orderBy("h", "class_id").limit(pivots).select("vector").toPandas()
    table = np.stack(picked["vector"].to_numpy()).astype(np.float64)
    prefix = min(prefix, len(table))
    near = written(_permutations(classes, table, prefix), "near")
    asks = rows.where("asks").select("id", "vector").distinct()
    name = ["class_id", "tag"]
    asks = written(asks.join(classes.select(*name, "vector"), "vector").select("id", *name), "asks")
    asking = near.join(asks.select(*name).distinct(), name, "left_semi")
    n = asks.select(*name).distinct().count()
    blocks = max(1, -(-n // (block * 3 // 4)))  # hashed, so somewhat uneven
    path, any_found = scratch_path(spark, "found"), False
    for i in range(blocks):
        own = asking.where(F.pmod(F.xxhash64(*name), F.lit(blocks)) == i).orderBy(*name).toPandas()
        if len(own):
            _search_block(near, own, len(table), k + 1, share, least, path)
            any_found = True
    if not any_found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("q", "q_tag").orderBy("score", "class_id", "tag")
    few = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).join(classes.select(*name, "ids"), name)
    entry = F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id"), F.col("class_id"), F.col("tag")))
    lists = few.groupBy("q", "q_tag").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("found"))
    own_row = lambda x: (x["vec_id"] == F.col("id")) & (x["class_id"] == F.col("q")) & (x["tag"] == F.col("q_tag"))
    out = asks.join(lists, (F.col("class_id") == F.col("q")) & (F.col("tag") == F.col("q_tag"))).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: ~own_row(x)), 1, k).alias("found"))
    out = out.select("query_id", F.posexplode("found").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
