"""Filter interaction, importance resampling and streaming BPE against brute force and the tokenizers library."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import bpe, interaction, queries, resampling

SCHEMA = "doc_id long, text string, lang string, part string, mask int, _id string, ids string, score string, bucket int, block string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, "x", "y", "z", 2, "b") for i, t, lang in rows], SCHEMA)


# filter interaction
LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, "en"), (None, LONG, "en"), (0, "short", ""), (5, None, "en"), (6, "", "de"), (4, "", None), (7, "A B C $", "de"),
    (8, LONG + " #", "en"), (9, "same word " * 200, "en"), (10, "é" * 30 + "ABCD", "de"), (11, "AAA" + LONG, "en"), (12, "x " * 30_000, "en"), (None, None, None),
]


def brute_masks(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        out.append((i, lang or "", fails))
    return out


def brute_audit(rows, good, toxic):
    masks, out = brute_masks(rows), []
    for part in {p for _, p, _ in masks}:
        own, shap, lines = [(i, f) for i, p, f in masks if p == part], Counter(), []
        for order in itertools.permutations(range(5)):
            left, gone = list(own), []
            for step, f in enumerate(order):
                now = [x for x in left if x[1][f]]
                redundant = sum(x[1][f] for x in gone)
                left = [x for x in left if not x[1][f]]
                gone += now
                shap[f] += len(now)
                only = sum(x[1] == [k == f for k in range(5)] for x in own)
                lines.append((f, (part, "".join("ABCDE"[k] for k in order), step + 1, len(left), len(now), redundant, only, sum(x[0] in good for x in now), sum(x[0] in toxic for x in now))))
        out += [(*line, shap[f]) for f, line in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (12, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in interaction.audit(docs_of(spark, TEXTS).repartition(3), labels).collect())
    assert got == brute_audit(TEXTS, {1, 2}, {2, 8})
    want = sorted(i for i, _, f in brute_masks(TEXTS) if f[4])
    assert sorted(r[0] for r in interaction.non_minimum(docs_of(spark, TEXTS)).collect()) == want


def test_audit_of_nothing(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(none, labels).collect() == []
    one = interaction.audit(docs_of(spark, [(1, None, None)]), labels).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r["removed"] for r in one) == 120


@pytest.mark.parametrize("held", [0, 300, 1 << 20])
def test_chains_survive_collisions_and_flushes(monkeypatch, held):
    monkeypatch.setattr(interaction, "HELD", held)
    rnd = random.Random(held)
    docs = [(rnd.choice([None, *range(12)]), rnd.choice([b"a", b"b", b"c", b""]), rnd.choice("xy")) for _ in range(200)]
    routed = [(rnd.choice([7]), (t, i, p, 0)) for i, t, p in docs]  # one fingerprint for all: nothing but whole texts tells them apart
    tasks = [list(interaction.without_copies(routed[k::3], 1)) for k in range(3)]
    got = Counter(interaction.chained(sorted(itertools.chain(*tasks), key=lambda x: x[0]), 1))
    least = {t: min(i for i, u, _ in docs if u == t and i is not None) for _, t, _ in docs}
    assert got == Counter((i, p, int(i is not None and i > least[t])) for i, t, p in docs)


def test_one_text_in_a_third_of_all_rows_travels_once_a_task():
    routed = [(1, (b"hot" * 100, i, "p", 0)) for i in range(30_000)] + [(i, (b"%d" % i, i, "p", 0)) for i in range(100)]
    out = list(interaction.without_copies(routed, 1))
    assert sum(v[0] is not None for _, v in out) == 101 and len(out) == 30_100


@pytest.mark.parametrize("name", ["op11_filter_interaction", "op12_inverted_resampling"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(tuple(map(repr, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(repr, r)) for r in want)


# resampling
def brute_resample(docs, target, longest=1, least=20, percent=10, buckets=resampling.BUCKETS):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, other = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in other for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for (i, _), (w, f) in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return rows


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("longest", [1, 2])
def test_resample_equals_brute_force(spark, longest):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "Alpha", "Éa", "x1", "...", "b-c", "zeta", "漢字"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([5, 19, 20, 60])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "long words " * 20_000), (7, docs[7][1]), (7, docs[7][1]), (None, docs[8][1])]
    target = ["the zeta zeta Alpha", None, "", "novel thing"]
    d = docs_of(spark, [(i, t, "en") for i, t in docs])
    b = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(d, b, longest=longest, percent=37).collect()
    assert got[0].__fields__ == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert plain(got) == plain(brute_resample(docs, target, longest, percent=37))


def test_resample_in_many_blocks_and_salts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SALTED_BLOCKS", 2)
    docs = [(i, "common " * 30 + f"word{i % 7}") for i in range(60)]
    d = docs_of(spark, [(i, t, "en") for i, t in docs]).repartition(6)
    assert plain(resampling.resample(d, spark.createDataFrame([("common word1",)], "text string")).collect()) == plain(brute_resample(docs, ["common word1"]))


def test_resample_of_nothing(spark):
    none, target = docs_of(spark, []), spark.createDataFrame([], "text string")
    assert resampling.resample(none, target).collect() == []
    assert plain(resampling.resample(docs_of(spark, [(1, "a b", "en")]), target).collect()) == plain(brute_resample([(1, "a b")], []))


# byte-pair encoding
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    return bpe.read_model()


PARTS = ["a", "e", "the", " ", "  ", "\n", "'", "'re", "'s", "'l", "r", "1", "23", "é", "ß", "漢", "😀", "-", "<|endoftext|>", "<|endof", "|>", "　", "\x85", "ÃÂ", "\U00010940", "Ᲊ", "\x1c", "="]


def encoded(model, text, step):
    own, out = bpe.Encoder(model, bpe.odd_classes()), []
    for at in range(0, len(text), step):
        out += own.feed(text[at : at + step])
    return out + own.finish()


def test_stream_equals_the_library(model, library):
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) * rnd.choice([1, 1, 1, 300]) for _ in range(rnd.choice([2, 8, 30])))
        step = rnd.choice([1, 2, 7, 100, 5000]) if len(text) < 1000 else rnd.choice([50, 999, 5000])
        ids = encoded(model, text, step)
        assert ids == library.encode(text, add_special_tokens=False).ids
        own = bpe.Decoder(model)
        cut = rnd.randrange(len(ids) + 1)
        assert own.feed(ids[:cut]) + own.feed(ids[cut:]) + own.finish() == library.decode(ids, skip_special_tokens=False) == text


def test_decoder_on_any_ids(model, library):
    rnd = random.Random(6)
    own = bpe.Decoder(model)
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(256), rnd.randrange(50257)]) for _ in range(rnd.randrange(30))]
        cut = rnd.randrange(len(ids) + 1)
        assert own.feed(ids[:cut]) + own.feed(ids[cut:]) + own.finish() == library.decode(ids, skip_special_tokens=False)


def test_window_stays_bounded(model):
    own = bpe.Encoder(model, {})
    for _ in range(40):
        own.feed("ab" * 5000)
        assert len(own.open) < model.window and len(own.rest) <= bpe.LONG
    assert len(own.finish()) > 0 and not own.open


def stagewise(rules, data):
    ids = [bytes([b]) for b in data]
    for a, b in rules:
        out = []
        for x in ids:
            if out and out[-1] == a and x == b:
                out[-1] = a + b
            else:
                out.append(x)
        ids = out
    return ids


def test_lookahead_suffices():
    rnd = random.Random(8)
    for _ in range(60):
        known, rules = [b"a", b"b"], []
        while len(rules) < 7:
            pair = (rnd.choice(known), rnd.choice(known))
            if pair[0] + pair[1] not in known:
                rules.append(pair)
                known.append(pair[0] + pair[1])
        need = bpe.lookahead(rules)
        for _ in range(60):
            text, more = (bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 30))) for _ in range(2))
            end, final = 0, []
            for t in stagewise(rules, text):
                end += len(t)
                if end <= len(text) - need:
                    final.append(t)
            assert stagewise(rules, text + more)[: len(final)] == final


def test_improper_vocabularies_are_refused():
    spec = {"model": {"type": "BPE", "vocab": {}, "merges": [["a", "bc"]]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": None}
    import json

    spec["model"]["vocab"] = {c: i for i, c in enumerate(bpe.byte_alphabet())} | {"bc": 256, "abc": 257}
    with pytest.raises(ValueError):
        bpe.Model(json.dumps(spec))


def test_query_equals_the_library(spark, sf, library):
    want = {}
    rows = duckdb.connect().sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in queries.op13_streaming_bpe(spark, sf).collect()}
    assert got == want


def test_bpe_edges(spark, library):
    rows = [(1, None, "en"), (2, "", "en"), (3, "tab\tand\n\n é漢😀 <|endoftext|> x", "en"), (3, "again", "en"), (None, "z" * 200_000, "en")]
    found = bpe.encode(docs_of(spark, rows))
    got = sorted((repr(r["doc_id"]), list(r["ids"])) for r in found.collect())
    assert got == sorted((repr(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted(r["text"] for r in bpe.decode(found).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.decode(bpe.encode(docs_of(spark, []))).collect() == []
    odd = spark.createDataFrame([(None,), ([None, 64, 999_999, 255],)], "ids array<int>")
    assert [r["text"] for r in bpe.decode(odd).collect()] == ["", library.decode([64, 255])]


def test_bpe_merges_together(model):
    draw, tokens = random.Random(7), [t for t in model.bytes_of.values() if len(t) < 20]
    pieces = [b"".join(draw.choices(tokens, k=draw.randrange(1, 7))) for _ in range(3000)] + [bytes(draw.choices(b" =-a0e", k=draw.randrange(1, 60))) for _ in range(3000)] + [bytes([b]) for b in range(256)]
    assert model.merged_together(pieces) == [bpe.packed(model.merged(p)) for p in pieces]
    assert model.merged_together([]) == []


def test_bpe_short_pieces_are_never_merged_alone(model, monkeypatch):
    want = bpe.Encoder(model, {}).feed("Unos xqzw palabros: 12345, fin. ")
    monkeypatch.setattr(bpe.Model, "_few", None)  # as it was, every new piece came by here
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(model, {})
    assert own.feed("Unos xqzw palabros: 12345, fin. ") == want and len(own.pieces) <= 3
    assert own.resolved([own.fed("x " * 9), [], own.finished()])[1] == b""
