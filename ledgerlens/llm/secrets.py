"""Secret scans over an incremental ledger of blobs, in DataFrame functions alone.

Every version of every text is addressed by its SHA-256. The ledger, a Parquet folder, says
which rules at which versions have seen a blob and what they found there. A scan looks only
at the pairs of blob and rule version that the ledger lacks, appends to it, and joins the
findings back to every path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, let, packed, running, scratch_path, sendable, written


@dataclass(frozen=True)
class SecretRule:
    """A pattern whose leftmost non-overlapping matches are findings if ``measured`` is long enough.

    measured: the group whose length counts, 0 for the whole match.
    hint: a cheap pattern that every text with a match has as well.
    """

    kind: str
    version: int
    pattern: str
    min_length: int
    measured: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    SecretRule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 20, hint=r"AKIA[A-Z0-9]{16}"),
    SecretRule("hex", 1, r"[0-9a-f]+", 24, hint=r"[0-9a-f]{24}"),
)
ADDED_RULES = (
    SecretRule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 20, hint="-----BEGIN "),
    SecretRule("forge", 1, r"gh[pousr]_[A-Za-z0-9]+", 30, hint="gh[pousr]_"),
    SecretRule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, hint=r"eyJ"),
    SecretRule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]+", 15, hint="xox[abprs]-"),
)
RULES = BASE_RULES + ADDED_RULES
#: A whole private key: its BEGIN line and all through the END line, or, where END is missing, the headers and base64 lines that follow.
KEY_BLOCK = SecretRule(
    "pem_block",
    1,
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}(?!-)[^-]*+){0,64}+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:[ \t\r]*+\n\s*+(?:Proc-Type|DEK-Info):[^\n]*+){0,8}+(?:[ \t\r]*+\n\s*+[A-Za-z0-9+/=]++(?![ \t]*+[^\s])|[\s\\]*+[A-Za-z0-9+/=]{40,}+)*+)",
    20,
    hint="-----BEGIN ",
)
#: What a text is freed from: with the rules that tell of secrets the one that spans whole keys.
REMOVED_RULES = (*RULES, KEY_BLOCK)
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: What the ledger keeps of a blob: for each rule version that has seen it the places found, which name no order of rules.
PLACES = "array<struct<start:int,end:int>>"
SCANS = f"array<struct<rule:string,places:{PLACES}>>"


def _places(x: Column) -> Column:
    """array<struct<start,end>>, in code points, of the matches of one rule that are long enough. Pieces between the matches give the places."""
    long = F.transform(x["found"], lambda m: F.char_length(m))
    steps = F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["found"])), long, lambda b, n: F.char_length(b) + n)

    def spans(n: Column) -> Column:
        rows = F.zip_with(running(steps, lambda a, b: a + b), n, lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
        kept = F.filter(F.arrays_zip(rows.alias("span"), x["measured"].alias("measured")), lambda r: F.char_length(r["measured"]) >= x["least"])
        return F.transform(kept, lambda r: r["span"])

    return let(long, spans)


def scan_text(text: Column, rules=RULES, wanted=lambda rule: F.lit(True)) -> Column:
    """What each wanted rule that finds anything finds in a text that is not null: array<struct<rule,places>>."""
    if not rules:
        return F.array().cast(SCANS)

    def matches(r: SecretRule) -> Column:
        found = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        measured = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.measured)) if r.measured else found
        whole = F.struct(F.lit(r.key).alias("rule"), F.lit(r.min_length).alias("least"), found.alias("found"), measured.alias("measured"), F.split(text, r.pattern).alias("between"))
        return F.when(wanted(r) & text.rlike(r.hint or r.pattern), whole)

    met = F.filter(F.array(*[matches(r) for r in rules]), lambda x: x.isNotNull())
    told = F.transform(met, lambda x: F.struct(x["rule"].alias("rule"), _places(x).alias("places")))
    return F.filter(told, lambda x: F.size(x["places"]) > 0).cast(SCANS)


def ledger_or_none(spark, ledger: str) -> DataFrame | None:
    """blob, rules (the versions that one scan held it against) and scans (what those found) of a ledger that is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ledger}/_SUCCESS")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"blob string, rules array<string>, scans {SCANS}").parquet(ledger) if there else None


def findings(known: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of the blobs of a ledger in which the given rule versions found anything.

    Only those versions are reported, and a pair that the ledger holds more than once counts once. rank is a
    rule's place among ``rules``, whatever the order was when the blob was scanned.
    """
    rules = tuple(rules)
    if not rules:
        return known.where("false").select("blob", F.array().cast(SPANS).alias("spans"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    asked = known.select("blob", F.explode(F.filter("scans", lambda s: F.array_contains(keys, s["rule"]))).alias("s"))
    once = asked.groupBy("blob").agg(F.collect_set("s").alias("scans"))

    def spans(s: Column) -> Column:
        rank = F.array_position(keys, s["rule"]).cast("int") - 1
        return F.transform(s["places"], lambda p: F.struct(p["start"].alias("start"), rank.alias("rank"), p["end"].alias("end"), F.get(kinds, rank).alias("kind")))

    return once.select("blob", F.array_sort(F.flatten(F.transform("scans", spans))).cast(SPANS).alias("spans"))


def scan_blobs(docs: DataFrame, ledger: str, rules=RULES, *, text_col: str = "text") -> DataFrame:
    """Brings a ledger up to date with all texts of ``docs`` and returns the findings (blob, spans) of the given rule versions."""
    spark = docs.sparkSession
    blobs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("blob", F.sha2("_text", 256)).dropDuplicates(["blob"])
    before = ledger_or_none(spark, ledger)
    own = blobs.select("blob")
    keys = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
    if before is None:
        unseen = blobs.withColumn("todo", keys)
        wanted = lambda rule: F.lit(True)
    else:
        seen = before.join(own, "blob", "left_semi").select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        unseen = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        unseen = unseen.where(F.size("todo") > 0)
        wanted = lambda rule: F.array_contains("todo", rule.key)
    unseen.select("blob", F.col("todo").alias("rules"), scan_text(F.col("_text"), rules, wanted).alias("scans")).write.mode("append").parquet(ledger)
    known = ledger_or_none(spark, ledger)
    # of a ledger that was there, the blobs of other texts are left out before anything is grouped
    return findings(known if before is None else known.join(own, "blob", "left_semi"), rules)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules=RULES, *, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: path_col, blob, spans array<struct<start,rank,end,kind>>.

    Offsets are code points, end exclusive. A null text counts as an empty one. Equal texts are one
    blob, scanned once; repeated rows each get its findings. Rows with a null path keep it. An
    empty table gives an empty result. Without ``ledger`` a new one is begun in the shared
    folder. Findings of rules or versions other than the given ones stay in the ledger, unreported. Scans that
    overlap, or that are repeated, may write a pair of blob and rule version twice; it is reported once.
    """
    known = scan_blobs(docs, ledger or scratch_path(docs.sparkSession, "blobs"), rules, text_col=text_col)
    addressed = docs.select(F.col(path_col).alias("_path"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    return addressed.join(known, "blob", "left").select(
        F.col("_path").alias(path_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with its spans, which stand by start, replaced; spans that overlap are replaced as one."""

    def merged(own: Column) -> Column:
        """array<struct<s,e,before>>: disjoint spans, each with the end of the one before it."""
        reach = running(F.transform(own, lambda x: x["end"]), lambda a, x: F.greatest(a, x))

        def firsts(far: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), far)  # before[i]: how far the spans ahead of the i-th reach
            rows = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda x, b: F.struct(x["start"].alias("s"), b.alias("before")))
            heads = F.filter(rows, lambda x: x["s"] >= x["before"])
            ends = lambda h: F.concat(F.transform(F.slice(h, F.lit(2), F.size(h) - 1), lambda x: x["before"]), F.array(F.element_at(far, -1)))
            return let(heads, lambda h: F.zip_with(h, ends(h), lambda x, e: F.struct(x["s"].alias("s"), e.alias("e"), x["before"].alias("before"))))

        return let(reach, firsts)

    def told(own: Column) -> Column:
        kept = cut(text, F.transform(own, lambda x: F.struct(x["before"].alias("start"), x["s"].alias("end"))))
        return F.concat(F.array_join(kept, mark), F.lit(mark), F.substring(text, F.element_at(own, -1)["e"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, let(merged(spans), told)).otherwise(text)


def without_secrets(docs: DataFrame, ledger: str | None = None, rules=REMOVED_RULES, *, path_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows of ``docs`` with their secrets replaced by a mark; length_col, if named, follows the new text."""
    found = written(scan_blobs(docs, ledger or scratch_path(docs.sparkSession, "blobs"), rules, text_col=text_col), "findings")
    found = sendable(found, F.lit(128) + 64 * F.size("spans"))  # few texts hold any: the texts themselves needn't move
    text = F.col(f"row.`{text_col}`")
    rows = packed(docs, own=F.sha2(F.coalesce(text_col, F.lit("")), 256)).join(found, F.col("own") == F.col("blob"), "left")
    rows = rows.withColumn("new", F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))))
    out = []
    for c in docs.columns:
        was = F.col(f"row.`{c}`")
        if c == text_col:
            was = F.col("new")
        elif c == length_col:
            was = F.when(F.col("spans").isNull(), was).otherwise(F.char_length("new").cast(docs.schema[c].dataType))
        out.append(was.alias(c))
    return rows.select(*out)
