"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is cut into blocks of equal numbers of tokens. Sources get blocks by highest quotients
(target / 1, 3, 5, ...), and so do the shards of each source; what a source's whole blocks lack of its
target, or have beyond it, goes to its shards as part of a block. Within a shard the documents, in seeded
order, make up one stream of tokens that is cut into blocks, the last one as short as it has to be; a seeded
permutation of the blocks is gone through, again and again if need be, until the shard's quota of tokens is met.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
REPEATS = 2
BLOCK_TOKENS = 32
#: Rows that a shard has, about; more only where there would be more than MOST_SHARDS, whose quotas the driver deals.
SHARD_ROWS = 2_000
MOST_SHARDS = 100_000
#: Rows of sources or shards, of some 50 bytes, that are sent to every executor; more are joined by shuffle.
FEW = 1_000_000
SEED = 20_240_601


def n_tokens(text):
    """White-space separated words: of the pieces between white space, those that are not empty."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: Fraction = SHARE, repeats: int = REPEATS) -> dict:
    """source -> its target, exactly. Sources stand by code point, null last, and weigh as ``weights``, repeating.

    Targets stop at ``repeats`` times the source's size; the excess goes to the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s if s is not None else ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(repeats * sizes[s] for s in full)
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > repeats * sizes[s] * whole}
        if not over:
            return {s: Fraction(repeats * sizes[s]) if s in full else Fraction(left * weight[s], 1) / whole for s in order}
        full |= over


def sainte_lague(votes: list, seats: int, limits: list | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier. limits: most seats of each.

    Seats start from a common divisor, found by bisection in floating point. From there seats are dealt,
    taken back or moved one by one by exact quotients until none that is held is lower than one that is not.
    """
    import numpy as np

    n = len(votes)
    limits = limits or [math.inf] * n
    if not n or not sum(votes) or seats <= 0:
        return [0] * n
    if sum(lim for v, lim in zip(votes, limits, strict=True) if v) <= seats:
        return [lim if v else 0 for v, lim in zip(votes, limits, strict=True)]
    size, most = np.array([float(v) for v in votes]), np.array(limits, dtype=np.float64)
    at = lambda divisor: np.minimum(most, np.floor((size / divisor + 1) / 2))
    high = 2 * float(size.max())
    low = high
    while at(low).sum() < seats:
        low /= 2
    for _ in range(64):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() >= seats else (low, middle)
    got = [int(g) for g in at(high)]
    # (the next seat's quotient, negative), and (the last seat's quotient): both give way to the earlier party
    fresh = lambda i: (-Fraction(votes[i]) / (2 * got[i] + 1), i)
    held = lambda i: (Fraction(votes[i]) / (2 * got[i] - 1), -i)
    up = [fresh(i) for i in range(n) if votes[i] and got[i] < limits[i]]
    down = [held(i) for i in range(n) if got[i]]
    heapq.heapify(up)
    heapq.heapify(down)

    def top(heap, key, usable):
        """The best entry that still says how its party stands."""
        while heap and not (usable(heap[0]) and heap[0] == key(abs(heap[0][1]))):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def move(i, by):
        got[i] += by
        if got[i] < limits[i]:
            heapq.heappush(up, fresh(i))
        if got[i]:
            heapq.heappush(down, held(i))

    left = seats - sum(got)
    while True:
        best = top(up, fresh, lambda e: got[e[1]] < limits[e[1]])
        worst = top(down, held, lambda e: got[-e[1]] > 0)
        if left > 0:
            move(best[1], 1)
            left -= 1
        elif left < 0:
            move(-worst[1], -1)
            left += 1
        elif best and worst and (best[0], best[1]) < (-worst[0], -worst[1]):
            move(-worst[1], -1)
            move(best[1], 1)
        else:
            return got


def shard_quotas(shards: list[tuple], source_targets: dict, block: int = BLOCK_TOKENS, repeats: int = REPEATS) -> dict:
    """(source, shard) -> tokens that the mix takes of it; shards: (source, shard, tokens).

    A shard gives as many blocks as hold ``repeats`` times its tokens. Quotas are whole blocks by highest quotients; the
    tokens between a source's blocks and its target (rounded) are then added to its shards, or taken off, by
    the most room first.
    """
    names = list(source_targets)
    seats = int(sum(source_targets.values()) // block)
    of: dict = {}
    for source, shard, size in shards:
        of.setdefault(source, []).append((shard, size))
    limits = [sum(-(-repeats * size // block) for _, size in of.get(s, [])) for s in names]
    by_source = dict(zip(names, sainte_lague([source_targets[s] for s in names], seats, limits), strict=True))
    out = {}
    for source, own in of.items():
        own.sort()
        room = [repeats * size for _, size in own]
        got = sainte_lague([size for _, size in own], by_source[source], [-(-r // block) for r in room])
        tokens = [min(block * g, r) for g, r in zip(got, room, strict=True)]
        lack = round(source_targets[source]) - sum(tokens)
        spare = (lambda k: room[k] - tokens[k]) if lack > 0 else (lambda k: tokens[k])
        for k in sorted(range(len(own)), key=lambda k: (-spare(k), k)):
            step = min(abs(lack), spare(k))
            tokens[k] += step if lack > 0 else -step
            lack -= step if lack > 0 else -step
            if not lack:
                break
        out.update({(source, shard): t for (shard, _), t in zip(own, tokens, strict=True)})
    return out


def _taken(sizes, quota: int, seed: int, block: int):
    """Tokens taken of each document of one shard, in the given order: ``quota`` in all."""
    import numpy as np

    sizes = np.asarray(sizes, dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), dtype=np.int64)
    n = -(-total // block)
    times, rest = divmod(quota, total)
    # i -> (a i + c) mod n permutes the blocks; in that order they are taken once more, the last of them in part
    a = 1 + (seed * 2654435761) % max(1, n - 1) if n > 1 else 1
    while math.gcd(a, n) != 1:
        a += 1
    places = (a * np.arange(n, dtype=object) + seed) % n if a * n > 2**62 else (a * np.arange(n, dtype=np.int64) + seed % n) % n
    edges = np.minimum(np.arange(n + 1, dtype=np.int64) * block, total)
    order = np.argsort(places.astype(np.int64), kind="stable")
    long = np.diff(edges)[order]
    before = np.cumsum(long) - long
    chosen = np.zeros(n, dtype=np.int64)
    chosen[order] = np.clip(rest - before, 0, long)  # tokens of each block, from its beginning
    covered = np.concatenate(([0], np.cumsum(chosen)))
    ends = np.cumsum(sizes)

    def upto(x):
        at = np.minimum(x // block, n - 1)
        return covered[at] + np.minimum(chosen[at], x - edges[at])

    return times * sizes + upto(ends) - upto(ends - sizes)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: id_col, size, source_size, target, taken.

    A null text has size 0; rows with a null source make up one source, which stands last. Nothing is
    taken of documents without words, and all that is taken of a source is its target, rounded. Rows that are
    equal in id, source and size are told apart by no more than their order, which changes no result; they are
    counted before they are dealt out, at most ``shard_rows`` of them to one place. An empty table gives an empty
    result. The driver holds a number for each source and each shard; shards have about ``shard_rows`` rows, or
    more where the table has more than ``most_shards`` times as many.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_tokens(F.col(text_col)).alias("size"))
    sized = written(sized.groupBy("_source", "_id", "size").agg(F.count("*").alias("copies")), "sizes")
    rows = {r["_source"]: r for r in sized.groupBy("_source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n")).collect()}
    sizes = {s: r["size"] for s, r in rows.items()}
    wanted = targets(sizes)
    shard_rows = max(shard_rows, -(-sum(r["n"] for r in rows.values()) // most_shards))
    # every source is dealt to as many shards as its rows ask for
    known = [(s, sizes[s], float(wanted[s]), max(1, -(-rows[s]["n"] // shard_rows))) for s in sizes]
    names = spark.createDataFrame(known, "_s string, source_size long, target double, shards int")
    placed = sized.join(F.broadcast(names) if len(known) < FEW else names, sized["_source"].eqNullSafe(names["_s"])).drop("_s")
    lots = F.transform(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / shard_rows)),
        lambda i: F.struct(i.alias("lot"), F.least(F.lit(shard_rows), F.col("copies") - i * shard_rows).alias("copies")),
    )
    placed = placed.withColumn("own", F.explode(lots)).withColumn("copies", F.col("own.copies"))
    placed = placed.withColumn("order", F.xxhash64("_id", "size", "own.lot", F.lit(seed))).drop("own")
    placed = placed.withColumn("shard", F.pmod(F.col("order"), F.col("shards")).cast("int"))
    shards = [(r["_source"], r["shard"], r["n"]) for r in placed.groupBy("_source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()]
    quotas = shard_quotas(shards, wanted, block)
    quota = spark.createDataFrame([(s, k, int(q)) for (s, k), q in quotas.items()], "_s string, _k int, quota long")
    placed = placed.join(F.broadcast(quota) if len(quotas) < FEW else quota, placed["_source"].eqNullSafe(quota["_s"]) & (placed["shard"] == quota["_k"])).drop("_s", "_k")
    kind = docs.schema[id_col].dataType.simpleString()

    def one(pdf):
        import xxhash

        pdf = pdf.sort_values(["order", "_id", "size"], kind="stable")
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])]
        own = int(xxhash.xxh64_intdigest(f"{pdf['_source'].iloc[0]}:{pdf['shard'].iloc[0]}:{seed}") >> 20)
        pdf["taken"] = _taken(pdf["size"].to_numpy(), int(pdf["quota"].iloc[0]), own, block)
        return pdf[["_id", "size", "source_size", "target", "taken"]]

    out = placed.groupBy("_source", "shard").applyInPandas(one, f"_id {kind}, size long, source_size long, target double, taken long")
    return out.withColumnRenamed("_id", id_col)
