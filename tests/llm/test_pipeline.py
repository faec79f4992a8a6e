"""The pipeline against stage-by-stage brute force."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import secrets, simhash

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text):
    w = PLAIN.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def expected(docs, bench):
    left = [d for d in docs if any(c.isalpha() for c in d.text or "")]
    prints = [simhash.fingerprint_text(d.text) for d in left]
    root = list(range(len(left)))
    changed = True
    while changed:
        changed = False
        for i in range(len(left)):
            for j in range(len(left)):
                if root[j] > root[i] and bin(prints[i] ^ prints[j]).count("1") <= 2:
                    root[j], changed = root[i], True
    kept = {}
    for d, r in zip(left, root, strict=True):
        kept[r] = min(kept.get(r, d), d, key=lambda x: x.doc_id)
    bad = set().union(*[windows(b.text) for b in bench])
    return {d.doc_id: d.text for d in kept.values() if not windows(d.text) & bad}


def test_pipeline_equals_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = expected(docs, spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        text = want[i]
        spans = spark_spans(text)
        for s, e in reversed(spans):
            text = text[:s] + "[secret]" + text[e:]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and 0 <= r.taken <= 2 * r["size"]


def spark_spans(text):
    """Spans of all rules, those that overlap joined."""
    own = []
    for r in secrets.RULES:
        own += [m.span() for m in re.finditer(r.pattern.replace("(?i:", "(?ai:"), text) if len(m.group(r.measured)) >= r.min_length]
    out = []
    for s, e in sorted(own):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "lang_pred", "blob", "row", "spans", "text_key", "_r")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.where("score != 'x' or blob != 'x' or row != 'x'").count() == 0
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_registered():
    names = list(entry.queries())
    assert [n for n in (f"op{i}_" for i in range(1, 11)) if not any(x.startswith(n) for x in names)] == [] and "pipeline" in names


def test_nulls_and_repeats_pass_through(spark, sf):
    long_text = "Of edatha thwhing to eron edtion the inoution was ble ndoution is ereash ha ndedan tion"
    rows = [(1, long_text, "en", "s", 9), (1, long_text, "en", "s", 9), (None, "zwei drei vier fünf sechs", None, None, None), (None, None, None, None, None), (2, "", "de", None, 0), (3, "123 456", "en", "s", None), (4, "token=abcdef12 hello", None, "s", 20), (5, "x" * 200_000, "en", "t", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "language":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 1, 4, 5]
        if name == "near_dedup":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 4, 5]
        if name == "secret_scan":
            assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}[4] == ("[secret] hello", 14)
    assert docs.count() == 4


def test_all_pairs_of_clashing_names_stay_apart(spark):
    rows = [(1, "alpha beta gamma", "k1"), (2, "delta epsilon zeta", "k2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({c: F.col("fp") for c in ("id", "root", "r", "own", "new", "component_id", "_kept_id", "_bad_id")})
    assert sorted(map(tuple, simhash.deduplicated(docs).collect())) == sorted(map(tuple, docs.collect()))
