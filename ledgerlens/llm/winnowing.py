"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are sequences of words, fingerprints are hashes of k consecutive words. Of each window of
``length`` words the smallest hash is kept together with its place, and where neighbouring windows keep the same
one it is kept once: about a quarter of all places. Equal windows keep equal hashes, so every shared span of at
least ``length`` words shares a kept fingerprint. Fingerprints of items and documents are joined, and a hit
is extended, word by word, to each window around it; windows that an item has as well are occurrences, and
overlapping ones make up whole spans.

An item of fewer words than ``length`` is one window of its own length. All lengths are winnowed in one
pass over the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, packed, plain_words, running, sendable, written

GRAM = 4
WINDOW_WORDS = 10
#: Benchmark windows that one broadcast holds (about 200 bytes each); more are joined by shuffle.
BLOCK_WINDOWS = 500_000
#: A kept fingerprint is a long: 33 bits of hash above the 30 bits of its place.
PLACE_BITS, HASH_BITS = 30, 33
#: A code that no place has; it marks a document's own row.
MARK = -1
#: Bytes of item ids that a window may carry to each of its hits; if any window has more, digests of the lists go in their place and lists are joined last.
LIST_BYTES = 4096


def _coded(words: Column, k: int) -> Column:
    """For each run of k words its hash and place in one long; a shorter text has none."""
    hashed = lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]).bitwiseAND((1 << HASH_BITS) - 1)
    every = F.transform(words, lambda w, i: F.shiftleft(hashed(w, i), PLACE_BITS).bitwiseOR(i.cast("long")))
    return F.slice(every, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))) if k > 1 else every


def _least(a: Column, shift: int) -> Column:
    """The lesser of a[i] and a[i + shift] for every i that has both."""
    n = F.greatest(F.size(a) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + shift), n), lambda x, y: F.least(x, y))


def winnowed(df: DataFrame, words: str, lengths: list[int], out: str, gram: int = GRAM) -> DataFrame:
    """Adds ``out`` array<long>: the codes that windows of any of ``lengths`` words keep, each once."""
    steps: dict[str, Column] = {}
    kept: list[str] = []
    for k in sorted({min(gram, n) for n in lengths}):
        steps[f"_g{k}_1"] = _coded(F.col(words), k)
        for span in sorted({n - k + 1 for n in lengths if min(gram, n) == k}):  # minima over as many grams
            reach = 1
            while reach < span:
                shift = min(reach, span - reach)
                steps.setdefault(f"_g{k}_{reach + shift}", _least(F.col(f"_g{k}_{reach}"), shift))
                reach += shift
            kept.append(f"_g{k}_{span}")
    for name, c in steps.items():
        df = df.withColumn(name, c)
    return df.withColumn(out, F.array_distinct(F.concat(*map(F.col, kept)))).drop(*steps)


def fingerprint(code: Column) -> Column:
    return F.shiftright(code, PLACE_BITS)


def place(code: Column) -> Column:
    return code.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")


def windows_around(words: Column, at: Column, n: Column, gram: int = GRAM) -> Column:
    """array<struct<at,window>>: the windows of n words that hold the k words at the place, by where they start and a digest of their words."""
    first = F.greatest(at - (n - F.least(F.lit(gram), n)), F.lit(0))
    last = F.least(at, F.size(words) - n)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.sha2(F.array_join(F.slice(words, s + 1, n), " "), 256).alias("window")))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, length: int = WINDOW_WORDS, gram: int = GRAM) -> tuple[list[int], DataFrame, DataFrame]:
    """The windows' lengths, the kept fingerprints (fp, len) and the windows (window, len, items), written.

    An item of fewer words than ``length``, but not none, is one window of its own length. window is the digest of
    its words; items are the ids, as sorted strings, of those that have it.
    """
    base = items.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    base = written(base.withColumn("len", F.least(F.size("words"), F.lit(length))), "items")
    lengths = sorted(r["len"] for r in base.select("len").distinct().collect())  # ``length`` numbers at most
    prints = None
    for n in lengths:
        own = winnowed(base.where(F.col("len") == n), "words", [n], "codes", gram).select(F.explode(F.transform("codes", fingerprint)).alias("fp"), "len")
        prints = own if prints is None else prints.unionByName(own)
    prints = prints if lengths else items.sparkSession.createDataFrame([], "fp long, len int")
    each = base.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1), lambda s: F.sha2(F.array_join(F.slice("words", s, F.col("len")), " "), 256))).alias("window"))
    windows = each.groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return lengths, written(prints.distinct(), "prints"), written(windows, "windows")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    length: int = WINDOW_WORDS,
    gram: int = GRAM,
    block_windows: int = BLOCK_WINDOWS,
    list_bytes: int = LIST_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id_col, text_key (a hash of the text), n_words, n_hit, hit_spans, items, contaminated.

    hit_spans are merged word ranges [start, end) covered by benchmark windows; items are the
    ids, as sorted strings, whose windows occur. Null and word-less texts have no words and
    no hits; repeated rows each get their result; an empty table gives an empty result; other
    columns are not looked at. Items whose id is null count for n_hit but are not listed.

    With up to ``block_windows`` windows in the benchmark its fingerprints are sent to all executors and documents
    are probed and extended where they are read. Beyond that fingerprints are joined by shuffle, and of the
    documents those with hits are read again. Where a window's item ids take more than ``list_bytes``, hits carry a digest of
    the list, and the lists are joined to the documents that have hits, once each.
    """
    lengths, prints, windows = benchmark_windows(items, item_id_col, item_text_col, length, gram)
    size = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    n_windows, widest = windows.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0))).first()
    few, lists = n_windows <= block_windows, None
    if widest > list_bytes:
        listed = windows.withColumn("list", F.sha2(F.to_json("items"), 256))
        lists = written(listed.select("list", "items").dropDuplicates(["list"]), "lists")
        windows = written(listed.select("window", "len", F.array("list").alias("items")), "listed")
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), plain_words(F.col(text_col)).alias("words"))
    coded = winnowed(keyed, "words", lengths or [length], "codes", gram)
    # each document also has one row that marks it, whether it has hits or not
    every = coded.select("_id", "_key", "words", F.explode(F.concat(F.array(F.lit(MARK).cast("long")), F.col("codes"))).alias("code"))
    if few:
        marked = prints.unionByName(docs.sparkSession.range(1).select(F.lit(MARK).cast("long").alias("fp"), F.lit(0).alias("len")))
        hits = every.withColumn("fp", fingerprint(F.col("code"))).join(F.broadcast(marked), "fp")
        near = F.when(F.col("len") == 0, F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("window")))).otherwise(windows_around(F.col("words"), place(F.col("code")), F.col("len"), gram))
        seen = hits.select("_id", "_key", F.when(F.col("len") == 0, F.size("words").cast("long")).alias("n_words"), "len", F.explode(near).alias("w"))
        seen = seen.select("_id", "_key", "n_words", "len", "w.at", "w.window")
        blank = docs.sparkSession.range(1).select(F.lit("").alias("window"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("items"))
        found = seen.join(F.broadcast(windows.unionByName(blank)), ["window", "len"])
    else:
        codes = every.select("_id", "_key", "code").where(F.col("code") != MARK).withColumn("fp", fingerprint(F.col("code")))
        hits = codes.join(prints, "fp").groupBy("_id", "_key").agg(F.collect_set(F.struct("code", "len")).alias("hits"))
        hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_key").alias("_hit_key"), "hits")
        again = keyed.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_key") == F.col("_hit_key")))
        near = again.select("_id", "_key", "words", F.explode("hits").alias("h"))
        near = near.select("_id", "_key", F.col("h.len").alias("len"), F.explode(windows_around(F.col("words"), place(F.col("h.code")), F.col("h.len"), gram)).alias("w"))
        found = near.select("_id", "_key", F.lit(None).cast("long").alias("n_words"), "len", "w.at", "w.window").join(windows, ["window", "len"])
        own = keyed.select("_id", "_key", F.size("words").cast("long").alias("n_words"), F.lit(0).alias("len"), F.lit(-1).alias("at"), F.array().cast("array<string>").alias("items"))
        found = found.select(*own.columns).unionByName(own)
    mark = F.col("n_words").isNotNull()
    per_doc = found.groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(mark).alias("copies"),
        F.array_sort(F.collect_set(F.when(~mark, F.struct(F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e"))))).alias("spans"),
        F.collect_set(F.when(~mark, F.col("items"))).alias("items"),
    )
    if lists is not None:
        per_doc = _with_lists(per_doc, sendable(lists, size))
    merged = per_doc.withColumn("hit_spans", _merged(F.col("spans")))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long"))
    out = merged.select(
        "_id", "n_words", n_hit.alias("n_hit"), "hit_spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), (F.size("hit_spans") > 0).alias("contaminated"), "_key",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    )
    return out.select(F.col("_id").alias(id_col), F.col("_key").alias("text_key"), "n_words", "n_hit", "hit_spans", "items", "contaminated")


def _with_lists(per_doc: DataFrame, lists: DataFrame) -> DataFrame:
    """per_doc with the lists (list, items) in place of their digests; documents without hits look for a digest of their own that isn't there."""
    none = F.concat(F.lit("none-"), F.hex(F.xxhash64("_id", "_key")))
    digests = F.array_distinct(F.flatten("items"))
    each = per_doc.withColumn("list", F.explode(F.when(F.size("items") > 0, digests).otherwise(F.array(none)))).drop("items")
    return each.join(lists, "list", "left").groupBy("_id", "_key").agg(*[F.first(c).alias(c) for c in ("n_words", "copies", "spans")], F.collect_set("items").alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("contaminated")
    bad = written(found.select(F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct(), "contaminated")
    bad = sendable(bad, F.lit(64) + F.coalesce(F.length(F.col("_bad_id").cast("string")), F.lit(0)))  # where they are few, the documents stay where they are
    rows = packed(docs, id=F.col(id_col), text_key=F.xxhash64(text_col))
    same = rows["id"].eqNullSafe(bad["_bad_id"]) & (rows["text_key"] == bad["_bad_key"])
    return rows.join(bad, same, "left_anti").select("row.*")


def _merged(spans: Column) -> Column:
    """Sorted [s, e) ranges as disjoint ranges; those that touch are one."""

    def joined(own: Column) -> Column:
        def parts(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(-1)), reach)
            rows = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda x, b: F.struct(x["s"].alias("s"), b.alias("b")))
            heads = F.filter(rows, lambda x: x["s"] > x["b"])
            ends = lambda h: F.concat(F.transform(F.slice(h, F.lit(2), F.size(h) - 1), lambda x: x["b"]), F.array(F.get(reach, F.size(reach) - 1)))
            return let(heads, lambda h: F.zip_with(h, ends(h), lambda x, e: F.struct(x["s"].alias("s"), e.alias("e"))))

        return let(running(F.transform(own, lambda x: x["e"]), lambda a, x: F.greatest(a, x)), parts)

    return F.when(F.size(spans) > 0, let(spans, joined)).otherwise(spans)
