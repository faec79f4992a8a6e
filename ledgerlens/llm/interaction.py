"""What filters remove, alone and together, in every order of applying them.

Texts are routed by fingerprint: the RDD is partitioned by the xxHash of the text, and each partition
keeps for one fingerprint a chain of the different texts under it, each whole and with its smallest id.
Documents with a larger id than their text's smallest one are copies. A task first drops what it can tell alone:
of equal texts that it read itself, only one with the smallest id travels with its text. Each document ends as
a mask of the filters it fails; masks are counted into one vector a part by ``combineByKey``, and
every order of the filters is read off the vector.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, sendable, written

#: Bytes of texts that a task holds while it drops equal texts, and that one routed partition is meant to have.
HELD, ROUTED = 32 << 20, 128 << 20
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUED = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def too_short(text: bytes) -> bool:
    """Under 100 words; bytes.split() splits at the six ASCII spaces alone."""
    return len(text.split()) < 100


def repetitive(text: bytes) -> bool:
    words = text.split()
    return 100 * len(set(words)) < 80 * len(words)


def shouting(text: bytes) -> bool:
    """More than a tenth of the code points are A-Z."""
    return 100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * len(text.translate(None, CONTINUED))


def signs(text: bytes) -> bool:
    return SIGNS.search(text) is not None


#: Filters by letter, on the UTF-8 bytes of a text; true where it fails. None: a copy of a document with a smaller id.
FILTERS: dict[str, Callable[[bytes], bool] | None] = {"A": too_short, "B": repetitive, "C": shouting, "D": signs, "E": None}

#: What is routed: a fingerprint with (text, id, part, mask) of a document; once a task has dropped its own copies, with (text, id, mask,
#: rows by part), or with (None, id, part, mask) of a document that is settled.
Routed = tuple[int, tuple]


def masks_of(rows: Iterable, filters: dict[str, Callable[[bytes], bool] | None]) -> Iterator[Routed]:
    tests = [(1 << i, f) for i, f in enumerate(filters.values()) if f]
    for fp, text, key, part in rows:
        data = bytes(text)
        yield fp, (data, key, part, sum(bit for bit, fails in tests if fails(data)))


def without_copies(routed: Iterable[Routed], copy_bit: int) -> Iterator[Routed]:
    """Settles what one task can: of equal texts with ids all but those of the smallest id are copies.

    Texts are held up to HELD bytes at a time, so the memory of a task is bounded; what is settled goes on without its text.
    """
    chains: dict[tuple[int, bytes], list] = {}  # (fingerprint, text) -> smallest id, mask, rows of that id by part
    held = 0
    for fp, (text, key, part, mask) in routed:
        if key is None:  # no id is smaller or larger than none
            yield fp, (None, key, part, mask)
            continue
        known = chains.get((fp, text))
        if known is None:
            chains[fp, text] = [key, mask, {part: 1}]
            held += len(text) + 300
            if held > HELD:
                yield from ((f, (t, *v)) for (f, t), v in chains.items())
                chains, held = {}, 0
        elif key > known[0]:
            yield fp, (None, key, part, mask | copy_bit)
        elif key == known[0]:  # rows that repeat an id are as small as each other
            known[2][part] = known[2].get(part, 0) + 1
        else:
            yield from ((fp, (None, *row)) for row in out_of(known, copy_bit))
            known[:] = [key, mask, {part: 1}]
    yield from ((f, (t, *v)) for (f, t), v in chains.items())


def out_of(known: list, bit: int = 0) -> Iterator[tuple[object, str, int]]:
    key, mask, parts = known
    for part, n in parts.items():
        yield from itertools.repeat((key, part, mask | bit), n)


def chained(routed: Iterable[Routed], copy_bit: int) -> Iterator[tuple[object, str, int]]:
    """(id, part, mask) of all documents of a partition whose rows come in the order of their fingerprints.

    The chain of one fingerprint is held at a time: every different text under it whole, with the smallest id seen
    and the rows that have it. A row is given out as a copy as soon as a smaller id is known.
    """
    now: int | None = None
    chain: dict[bytes, list] = {}
    for fp, (text, *found) in routed:
        if text is None:
            yield tuple(found)
            continue
        if fp != now:
            for known in chain.values():
                yield from out_of(known)
            now, chain = fp, {}
        known = chain.get(text)
        if known is None:
            chain[text] = found
        elif found[0] < known[0]:
            yield from out_of(known, copy_bit)
            chain[text] = found
        elif found[0] > known[0]:
            yield from out_of(found, copy_bit)
        else:
            for part, n in found[2].items():
                known[2][part] = known[2].get(part, 0) + n
    for known in chain.values():
        yield from out_of(known)


def failures(docs: DataFrame, *, filters: dict[str, Callable[[bytes], bool] | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id_col, ``part`` and ``mask`` long, whose bit i is set where filter i fails.

    A null text is empty, a null part the empty string. A document fails the copy filter if the whole table has its
    text under a smaller id; rows that repeat an id and text are no copies of each other, and a row without an id
    neither is nor has a copy. Equality is of whole texts, never of fingerprints alone.
    """
    kind = docs.schema[id_col].dataType
    spark = docs.sparkSession
    bit = sum(1 << i for i, f in enumerate(filters.values()) if f is None)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"), F.col(id_col).alias("key"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    routed = rows.rdd.mapPartitions(lambda x: masks_of(x, filters))
    if bit:
        n = routed_partitions(docs, text)
        # Settled rows stay with no fingerprint: they are dealt by their id, so that a hot text's copies spread.
        spread = routed.mapPartitions(lambda x: ((fp if v[0] is not None else hash_of(v[1]), v) for fp, v in without_copies(x, bit)))
        settled = spread.repartitionAndSortWithinPartitions(n, lambda fp: fp % n).mapPartitions(lambda x: chained(x, bit))
    else:
        settled = routed.map(lambda x: x[1][1:])
    return spark.createDataFrame(settled, f"`{id_col}` {kind.simpleString()}, part string, mask long", verifySchema=False)


def hash_of(key) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(key))


def routed_partitions(docs: DataFrame, text) -> int:
    """So many partitions that each has ROUTED bytes of texts on average, and the session's number at least."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTED))


def non_minimum(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of all rows whose text the table has under a smaller id."""
    part = fresh("part", [id_col, text_col])
    found = failures(docs.select(id_col, text_col, F.lit("").alias(part)), filters={"E": None}, id_col=id_col, text_col=text_col, part_col=part)
    return found.where(F.col("mask") == 1).select(id_col)


def counted(marked: RDD, n_filters: int) -> RDD:
    """(part, [documents, good ones, toxic ones] of each mask, one after another) from (part, mask, good, toxic).

    Every task adds its documents to one vector a part before anything is sent.
    """
    size = 3 << n_filters

    def add(v: list[int], x: tuple[int, int, int]) -> list[int]:
        v[3 * x[0]] += 1
        v[3 * x[0] + 1] += x[1]
        v[3 * x[0] + 2] += x[2]
        return v

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    return marked.map(lambda x: (x[0], x[1:])).combineByKey(lambda x: add([0] * size, x), add, merge, partitionFunc=hash_of)


def orders_of(part: str, v: list[int], letters: str) -> Iterator[tuple]:
    """A row for each step of each order of the filters; see ``audit``."""
    n = range(len(letters))
    first: dict[tuple[int, int], tuple] = {}  # (filter, filters before it) -> what it does there
    for f in n:
        for before in (b for b in range(1 << len(letters)) if not b >> f & 1):
            here = [m for m in range(1 << len(letters)) if m >> f & 1 and not m & before]
            failing = sum(v[3 * m] for m in range(1 << len(letters)) if m >> f & 1)
            removed, good, toxic = (sum(v[3 * m + k] for m in here) for k in range(3))
            kept = sum(v[3 * m] for m in range(1 << len(letters)) if not m & (before | 1 << f))
            first[f, before] = (kept, removed, failing - removed, v[3 << f], good, toxic)
    steps = []
    for order in itertools.permutations(n):
        before = 0
        for step, f in enumerate(order):
            steps.append((order, step, f, first[f, before]))
            before |= 1 << f
    total = [sum(x[1] for _, _, g, x in steps if g == f) for f in n]
    for order, step, f, x in steps:
        yield (part, "".join(letters[i] for i in order), step + 1, *x, total[f])


def audit(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable[[bytes], bool] | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, and counts of the part's documents.

    kept: left after the step; removed: by it; redundant: failing its filter, removed before; unique_fails: failing its filter
    alone; good_lost, toxic_lost: removed by it and labelled so; shapley: removed by its filter over all orders together.
    ``failures`` says what null texts, parts and ids and repeated rows mean. A label is that of an id: 1 where any of its rows
    says 1; labels without an id count for none. No documents, no parts. The orders are as many as the factorial of the filters,
    so there should be few of them.
    """
    letters = "".join(filters)
    found = failures(docs, filters=filters, id_col=id_col, text_col=text_col, part_col=part_col)
    says = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).cast("int")
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(says(good_col).alias("_good"), says(toxic_col).alias("_toxic")).where("_good + _toxic > 0")
    told = sendable(written(told, "audit-labels"), F.lit(64))
    marked = found.join(told, found[id_col] == told["_id"], "left").select("part", F.col("mask").cast("int"), F.coalesce("_good", F.lit(0)), F.coalesce("_toxic", F.lit(0)))
    vectors = counted(marked.rdd.map(tuple), len(letters))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: orders_of(x[0], x[1], letters)), schema, verifySchema=False)
