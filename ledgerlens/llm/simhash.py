"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at
most two bits, one segment differs in at most one, so with one bit of that segment left out they
agree. Each distinct fingerprint is posted under its 64 one-wildcard variants; an equality
of keys brings candidates together, and the whole fingerprints decide.

Fingerprints are made in Arrow batches; all else is DataFrame work, but for the comparison inside a
key's run, which takes 8 bytes for each distinct fingerprint and emits a spanning forest
of the links instead of all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import packed, written
from ledgerlens.llm.components import connected

SHINGLE = 3
SEED = 42
BITS = 2
#: Runs up to this length have all their links emitted; longer ones a spanning forest.
SHORT_RUN = 6
#: Up to this length a run's pairs are compared; of longer ones those that agree but for two bits are brought together by sorting.
DENSE_RUN = 2048


def fingerprint_text(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; a text without words has 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone; ASCII white space alone
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, text_key, fp): each row's id, a hash of its text, and its fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        for batch in rows:
            fps = np.fromiter((fingerprint_text(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["_id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(batches, f"_id {kind.simpleString()}, text_key long, fp long")


def linked_in_run(fps):
    """(members that are no root, root of each) of one run of distinct fingerprints: what its close pairs connect.

    Pairs of a long run are never gone through. Fingerprints that are equal but for two given bits are all
    linked to one another, so for each two bits that vary in the run a sort brings its links together:
    n log n work for each of the 528 pairs that the 33 bits outside a key's have.
    """
    import numpy as np

    n = len(fps)
    root = np.arange(n)

    def join(a, b):
        """Joins the components of nodes a and b, pair by pair."""
        nonlocal root
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                return
            to = np.arange(n)
            np.minimum.at(to, high[apart], low[apart])
            while (to[to] != to).any():
                to = to[to]
            root = to[root]

    if n <= DENSE_RUN:
        for at in range(0, n, 256):
            a, b = np.nonzero(np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= BITS)
            join(a + at, b)
    else:
        varying = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [np.uint64(1 << b) for b in range(64) if int(varying) >> b & 1]
        for one, two in combinations(bits, BITS) if len(bits) >= BITS else [(varying, varying)]:
            left = fps & ~(one | two)
            order = np.argsort(left)
            same = np.flatnonzero(left[order[1:]] == left[order[:-1]])
            join(order[same], order[same + 1])
            if not root.any():  # all are one component
                break
    return np.flatnonzero(root != np.arange(n)), root


def _links(keyed: DataFrame) -> DataFrame:
    """(a, b) of rows (key, fp) that stand sorted by key within their partitions."""

    def batches(rows):
        import numpy as np
        import pyarrow as pa

        def found(keys, fps):
            out_a, out_b = [], []
            breaks = np.flatnonzero(np.diff(keys)) + 1
            starts = np.concatenate(([0], breaks))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            for size in range(2, SHORT_RUN + 1):  # all runs of one size at once
                at = starts[sizes == size]
                for i in range(size):
                    for j in range(i + 1, size):
                        a, b = fps[at + i], fps[at + j]
                        near = np.bitwise_count(a ^ b) <= BITS
                        out_a.append(a[near])
                        out_b.append(b[near])
            for k in np.flatnonzero(sizes > SHORT_RUN):
                run = np.sort(fps[starts[k] : starts[k] + sizes[k]].view(np.int64)).view(np.uint64)  # roots are the smallest, as in connected()
                own, root = linked_in_run(run)
                out_a.append(run[own])
                out_b.append(run[root[own]])
            a, b = np.concatenate(out_a or [fps[:0]]), np.concatenate(out_b or [fps[:0]])
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["a", "b"])

        keys, fps = [], []
        for batch in rows:
            if not batch.num_rows:
                continue
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            # the last key may go on in the next batch
            cut = int(np.searchsorted(k, k[-1], side="left"))
            if cut:
                yield found(np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]]))
                keys, fps = [], []
            keys.append(k[cut:])
            fps.append(f[cut:])
        if keys:
            yield found(np.concatenate(keys), np.concatenate(fps))

    return keyed.mapInArrow(batches, "a long, b long")


def variant_keys(fp: str = "fp"):
    """The 64 keys of a fingerprint: segment and wildcard bit above, the segment without that bit below."""
    keys = []
    for segment in range(2):
        part = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)) if segment == 0 else F.shiftrightunsigned(F.col(fp), 32)
        for bit in range(32):
            keys.append(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit((segment * 32 + bit) << 32)))
    return F.array(*keys)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id_col, text_key, fp (signed long), component_id, root.

    component_id is the smallest id reachable over links of at most two differing bits; a null id
    is never the smallest, and is the component's only where no row in it has an id. root is a
    fingerprint that names the component. Texts without words, null ones too, have
    fingerprint 0 and link as any other. Repeated rows stay; an empty table gives an empty
    result; other columns are not looked at.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("first_id"))
    keyed = nodes.select(F.explode(variant_keys()).alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    roots = connected(_links(keyed).distinct())
    linked = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = linked.join(least, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp").select(F.col("_id").alias(id_col), "text_key", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one of the smallest id (null last), then of the lowest text hash.

    Of rows that share id and text one stays, by their other columns' JSON, the smallest first; the columns may be of
    any type. Whole rows are shuffled once.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    pick = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_key"))
    kept = found.groupBy("root").agg(pick.alias("p")).select(F.col("p.id").alias("_kept_id"), F.col("p.text_key").alias("_kept_key"))
    kept = kept.withColumn("_kept", F.xxhash64("_kept_id", "_kept_key"))
    rows = packed(docs, id=F.col(id_col), text_key=F.xxhash64(text_col))
    rows = rows.withColumn("at", F.xxhash64("id", "text_key"))
    # one key for the join, so that the window below finds its rows together already; what else must hold is no key
    really = rows["id"].eqNullSafe(kept["_kept_id"]) & (rows["text_key"] == kept["_kept_key"])
    same = (rows["at"] == kept["_kept"]) & F.when(really, True).otherwise(False)
    rows = rows.join(kept.hint("merge"), same, "left_semi")
    rest = F.to_json(F.struct(*[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)], F.lit(0).alias("end")))
    order = Window.partitionBy("at", "id", "text_key").orderBy("rest")
    return rows.withColumn("rest", rest).withColumn("r", F.row_number().over(order)).where("r = 1").select("row.*")
