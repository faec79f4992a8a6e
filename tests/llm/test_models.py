"""Tokens, mixing, quality, neighbours, near-duplicates and languages against brute force and round trips."""

import math
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import components, cotraining, langid, mixing, permutation, queries, simhash, tokens

EDGES = [None, "", "...", "É", "word " * 30_000, "same text here", "same text here"]


def docs_of(spark, texts, ids=None, source="s"):
    rows = [(i if ids is None else ids[i], t, source, "en", "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _id string, fp long, size long")


# tokens
@pytest.fixture(scope="module")
def encoder():
    return {r: tokens.Attributor(tokens.load_ranks(), tokens.PATTERN, r) for r in tokens.RULES}


HARD = ["héllo wörld\nzweite Zeile\n", "😀😀 emoji\n\n\nx", "\n", "no newline", "tab\tand  spaces \n end", "漢字かな交じり文\n改行"]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_equals_brute_force(encoder, rule):
    own = encoder[rule]
    for text in [*HARD, "a b c" * 200]:
        ids = own.encode(text)
        data = text.encode()
        pieces = [own.encoding.decode_single_token_bytes(int(i)) for i in ids]
        assert b"".join(pieces) == data  # an exact round trip
        starts, ends = tokens.line_edges(text)
        want, at = [0] * len(starts), 0
        for p in pieces:
            first = len(data[:at].decode(errors="ignore"))
            last = len(data[: at + len(p)].decode(errors="ignore")) + (0 if is_whole(data, at + len(p)) else 1)
            parts = [max(0, min(e, last) - max(s, first)) for s, e in zip(starts, ends, strict=True)]
            inside = [i for i, x in enumerate(parts) if x > 0]
            want[{"first": inside[0], "last": inside[-1], "largest": int(np.argmax(parts))}[rule]] += 1
            at += len(p)
        got, outside, crossing = own.attribute(text, starts, ends)
        assert got.tolist() == want and outside == 0 and got.sum() == len(ids)


def is_whole(data, at):
    return at >= len(data) or data[at] & 0xC0 != 0x80


def test_token_sections_and_edges(spark):
    d = docs_of(spark, [*HARD, *EDGES])
    got = tokens.attribute_tokens(d).orderBy("doc_id").collect()
    assert len(got) == len(HARD) + len(EDGES)
    assert all(r.n_tokens == sum(s.tokens for s in r.sections) + r.n_outside for r in got)
    assert [r.n_tokens for r in got[len(HARD) : len(HARD) + 2]] == [0, 0]
    named = d.withColumn("sec", F.expr("array(named_struct('section','b','start',3,'end',99999), named_struct('section','a','start',-5,'end',4), null, named_struct('section','c','start',9,'end',2))"))
    for r in tokens.attribute_tokens(named, sections_col="sec", rule="largest").collect():
        assert r.n_tokens == sum(s.tokens for s in r.sections) + r.n_outside
    assert tokens.attribute_tokens(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        tokens.attribute_tokens(d, rule="none")


def test_very_long_blanks_encode(encoder):
    for text in (" " * 300_000, "a" * 300_000, "\n" * 100_000):
        assert encoder["first"].spans(text)[1][-1] == len(text)


# mixing
def test_targets_are_capped_and_shared():
    got = mixing.targets({"a": 100, "b": 10_000, "c": 10_000, None: 7})
    assert got["a"] == 200 and got[None] == 14 and sum(got.values()) == Fraction(3, 2) * 20_107
    assert got["b"] * 2 == got["c"]  # b weighs 1, c 2
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_sainte_lague_equals_dealing_one_by_one():
    rng = random.Random(3)
    for _ in range(40):
        votes = [rng.randint(0, 500) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 60)
        want = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            want[max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats) == want


def dealt(votes, seats, limits):
    got = [0] * len(votes)
    for _ in range(seats):
        can = [(-Fraction(v) / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v and g < limits[i]]
        if can:
            got[min(can)[1]] += 1
    return got


def test_sainte_lague_of_many_tiny_parties():
    for votes, seats in (([1000] + [6] * 100, 160), ([1000] + [1] * 300, 400), ([1000] + [6] * 300, 160)):
        assert mixing.sainte_lague(votes, seats) == dealt(votes, seats, [seats] * len(votes))
    rng = random.Random(11)
    for _ in range(60):
        votes = [rng.choice([0, 1, 2, 3, Fraction(1, 3), rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 40))]
        limits = [rng.randrange(0, 40) for _ in votes]
        seats = rng.randrange(0, 300)
        assert mixing.sainte_lague(votes, seats, limits) == dealt(votes, seats, limits)


def test_mix_keeps_its_contract(spark, sf):
    rows = queries.op3_sainte_lague_mix(spark, sf).toPandas()
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    m = rows.merge(texts, on="doc_id")
    assert len(m) == len(texts) and (m["size"] == m.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))).all()
    assert (m.taken >= 0).all() and (m.taken <= 2 * m["size"]).all()
    g = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), said=("source_size", "first"))
    assert (g["size"] == g.said).all() and (abs(g.taken - g.target) <= 1).all()
    again = queries.op3_sainte_lague_mix(spark, sf).toPandas()
    key = ["doc_id", "taken"]
    assert rows.sort_values(key)[key].to_numpy().tolist() == again.sort_values(key)[key].to_numpy().tolist()


def test_mix_edges_and_shards(spark):
    d = docs_of(spark, EDGES).unionByName(docs_of(spark, ["a b c d"] * 50, source=None)).unionByName(docs_of(spark, ["x y"], [None], source=None))
    got = mixing.mix(d, shard_rows=7).collect()
    assert len(got) == len(EDGES) + 51 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {r.source_size for r in got} == {sum(len((t or "").split()) for t in EDGES), 202}
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_blocks_are_taken_evenly():
    sizes = np.array([5, 0, 1000, 3, 64, 0, 7])
    total = int(sizes.sum())
    for quota in (0, 1, 31, 32, 33, total // 2, total, total + 3, 2 * total - 1, 2 * total):
        taken = mixing._taken(sizes, quota, 12345, 32)
        assert (taken >= 0).all() and (taken <= 2 * sizes).all() and taken.sum() == quota
    assert (mixing._taken(sizes, 2 * total, 12345, 32) == 2 * sizes).all()


def test_small_sources_meet_their_targets(spark):
    small = {"a": [33], "b": [40], "c": [5, 3], "d": [1], "e": [0, 17], None: [70, 70, 1]}
    rows = [(i, "w " * n, s) for s, sizes in {**small, "z": [900] * 40}.items() for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_rows=2).toPandas()
    g = got.assign(key=got.source_size.astype(str) + got.target.astype(str)).groupby("key").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(g) == 7 and (abs(g.taken - g.target) <= 0.5).all() and (got.taken <= 2 * got["size"]).all()
    assert {66.0, 80.0, 16.0, 2.0} <= set(g.target)  # twice the size of each small source


def test_equal_rows_are_dealt_to_many_shards(spark):
    rows = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x " * 50).alias("text"), F.lit("t").alias("source")))
    one, two = (mixing.mix(rows.repartition(n), shard_rows=100).toPandas() for n in (3, 7))
    key = lambda r: sorted(zip(r.doc_id.fillna(-1), r["size"], r.taken, strict=True))
    assert len(one) == 3_010 and key(one) == key(two) and one.groupby("target").taken.sum().to_dict() == {x: round(x) for x in set(one.target)}


# quality
def test_quality_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    away = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = cotraining.fit_quality(docs, labels.where(~away))
    got = cotraining.classify_quality(docs, model).join(labels.where(away), "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95 and got.score.between(0, 1).all()
    assert sum(model["passed"]) > 0  # the views did teach each other


def test_the_surest_of_all_documents_are_passed(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs_of(spark, EDGES, [None] * len(EDGES)).select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars")))
    known = labels.select(F.col("doc_id").alias("_id")).distinct()
    rows = cotraining._rows(docs, "doc_id", "text", "lang", "source", "n_chars")
    rng = np.random.default_rng(5)
    weights = [rng.normal(size=cotraining.BINS + 1) * 3, rng.normal(size=12 + 2 * cotraining.SOURCE_BINS + 1) * 2]
    counts = {1: 7, 0: 4}
    got = sorted(tuple(r)[:3] for r in cotraining.surest(rows.repartition(5), known, weights, counts).collect())
    ids = {r[0] for r in known.collect()}
    own = {r.key: r for r in rows.collect() if r._id not in ids}
    want = []
    for v, of in enumerate((lambda r: cotraining.content_features(r.text), lambda r: cotraining.page_features(r.text, r.lang, r.source, r.length))):
        p = {k: 1 / (1 + math.exp(-float(np.clip(cotraining.margins(of(r)[None], weights[v])[0], -30, 30)))) for k, r in own.items()}
        for y in (1, 0):
            sure = sorted(((-(x if y else 1 - x), k) for k, x in p.items() if (x if y else 1 - x) >= cotraining.SURE))
            want += [(v, y, k) for _, k in sure[: counts[y]]]
    assert got == sorted(want) and len(got) > 8


def test_rows_of_many_copies_are_ranked_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = cotraining._rows(docs, "doc_id", "text", "lang", "source", "n_chars")
    known = spark.createDataFrame([], "_id long")
    rng = np.random.default_rng(6)
    weights = [rng.normal(size=cotraining.BINS + 1) * 3, rng.normal(size=12 + 2 * cotraining.SOURCE_BINS + 1) * 2]
    once = cotraining.surest(rows, known, weights, {1: 9, 0: 5})
    copies = rows.unionByName(rows.where("_id < 5").crossJoin(spark.range(400).select()))
    many = cotraining.surest(copies, known, weights, {1: 9, 0: 5})
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, once.collect()))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [key")  # copies are merged below the ranking


def test_quality_query_scores_equal_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotraining.fit_quality(docs, labels)
    texts = {r.doc_id: r for r in docs.collect()}
    for r in queries.op5_cotrained_quality(spark, sf).collect():
        d = texts[r.doc_id]
        views = [x[None] for x in (cotraining.content_features(d.text), cotraining.page_features(d.text, d.lang, d.source, d.n_chars))]
        assert np.allclose([r.content_score, r.page_score, r.score], [float(x[0]) for x in cotraining.score_views(model, *views)], atol=1e-5) and r.keep == (r.score >= 0.5)


def test_quality_edges(spark):
    d = docs_of(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = cotraining.classify_quality(d, cotraining.fit_quality(d, none)).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(0, 1), (0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in cotraining.classify_quality(d, cotraining.fit_quality(d, one)).collect()} == {1.0}
    assert cotraining.classify_quality(docs_of(spark, []), {"constant": 0.5}).count() == 0


# neighbours
def exact(rows, queries_, k):
    out = {}
    for q, v in queries_:
        near = sorted((float(np.sqrt(((np.array(x, dtype=float) - np.array(v, dtype=float)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbour_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    v, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op7_permutation_index(spark, "/root/testdata/sf0.1").toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(axis=1))
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, [d[ids == i][0] for i in own.vec_id], rtol=1e-12)
        hit += len(set(want) & set(own.vec_id))
        total += 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("shape", ["spread", "clustered", "dense"])
def test_most_rows_are_left_out(shape):
    rng = np.random.default_rng(3)
    n, dim = 6_000, 48
    v = rng.normal(size=(n, dim))
    if shape != "spread":
        v[: n if shape == "clustered" else n // 3] = (rng.normal(size=(40 if shape == "clustered" else 1, dim)).repeat(n, 0)[:n] if shape == "dense" else rng.normal(size=(40, dim))[rng.integers(0, 40, n)])[: n if shape == "clustered" else n // 3]
        v[: n if shape == "clustered" else n // 3] += rng.normal(size=(n if shape == "clustered" else n // 3, dim)) * 0.3
    p = v[rng.choice(n, permutation.PIVOTS, replace=False)]
    near = np.argsort((p * p).sum(1) - 2 * v @ p.T, axis=1)[:, : permutation.PREFIX].astype(np.int32)
    ids, asking, reached = np.arange(n), np.arange(0, n, 60), []
    q, c, _ = permutation._search_shard(ids, v, near, v[asking], near[asking], len(p), 11, permutation.RERANK_SHARE, permutation.LEAST_RERANK, reached)
    true = np.argsort(((v[asking][:, None] - v[None]) ** 2).sum(-1), axis=1)[:, :11]
    recall = np.mean([len(set(c[q == i]) & set(t)) / 11 for i, t in enumerate(true)])
    assert recall >= 0.9 and np.mean([r / m for _, r, m in reached]) < 0.15


def test_neighbours_in_several_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    own = [sorted(map(tuple, permutation.search(df, F.col("vec_id") % 3 == 0, block=b).collect())) for b in (16, permutation.BLOCK)]
    assert own[0] == own[1] and len(own[0]) == 1_000
    want = exact(rows, [r for r in rows if r[0] % 3 == 0], 10)
    assert sum(len({x[2] for x in own[0] if x[0] == q} & set(w)) for q, w in want.items()) >= 990


def test_another_vector_under_the_same_id(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.5]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    got = permutation.search(df, F.col("embedding")[1] == 0.5).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 0), (0, 2, 1)]


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), *[(i, [0.5, 0.5]) for i in range(1, 40)], (100, [0.5, 0.5]), (200, [0.0, 0.0]), (300, None), (400, [float("nan"), 1.0]), (500, [1.0, None]), (600, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("pivot", F.lit(1))
    got = permutation.search(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))).orderBy("query_id", "rank").collect()
    want = exact([(i, x) for i, x in rows[:41]], [(0, rows[0][1]), (100, rows[40][1])], 10)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want and {r.query_id for r in got} == set(want)
    assert permutation.search(df.where("false"), F.lit(True)).count() == 0
    assert permutation.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


@pytest.mark.parametrize("copies", [{1: 2}, {1: 11}, {6: 30}])
def test_neighbours_of_repeated_rows(spark, copies):
    group = [(i, [0.5, 0.5]) for i in range(1, 13)]
    rows = [r for r in group for _ in range(copies.get(r[0], 2))] + [(100 + i, [float(i), 1.0]) for i in range(1, 30)]
    got = permutation.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") <= 12).collect()
    for q, want in exact(dict(rows).items(), group, 10).items():
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[1] for x in own] == want and [x[0] for x in own] == list(range(1, 11)) and {x[2] for x in own} == {0.0}


# near-duplicates
def brute_print(text):
    ws = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_equal_brute_force():
    for t in ["A b C d", "one", "two words", "É É é x", "a\x0bb\x1cc d e f", "x y z x y z", *(e for e in EDGES if e is None or len(e) < 100)]:
        assert simhash.fingerprint_text(t) == brute_print(t)


def brute_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def clusters(seed):
    rng = random.Random(seed)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.append(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    fps += [rng.getrandbits(64) for _ in range(60)]
    return fps


@pytest.mark.parametrize("dense", [4096, 4])
def test_links_equal_brute_force(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE_RUN", dense)
    fps = sorted(set(clusters(5)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    keyed = df.select(F.explode(simhash.variant_keys()).alias("key"), "fp").repartition(3, "key").sortWithinPartitions("key")
    roots = {r.node: r.root for r in components.connected(simhash._links(keyed)).collect()}
    want = brute_components(fps)
    groups: dict = {}
    for f, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(f)
    own: dict = {}
    for f in signed:
        own.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, groups.values()))


def test_large_runs_keep_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "DENSE_RUN", 16)
    fps = np.array(sorted(set(clusters(9))), dtype=np.uint64)
    _, root = simhash.linked_in_run(fps)
    want = brute_components([int(x) for x in fps])
    assert len(set(root)) == len(set(want)) and all((root[i] == root[j]) == (want[i] == want[j]) for i in range(0, len(fps), 7) for j in range(len(fps)))


def test_a_hot_key_is_linked_in_seconds():
    rng = np.random.default_rng(2)
    n = 100_000
    spread = np.unique(rng.integers(0, 2**32, n, dtype=np.uint64))  # the low 32 bits vary, the key's 31 are the same
    tight = np.unique(rng.integers(0, 2**19, n, dtype=np.uint64))
    chain = np.array([(1 << (i + 1)) - 1 for i in range(32)], dtype=np.uint64)  # each one bit from the next
    for fps in (spread, tight, np.concatenate([spread[spread > 2**31], chain[:30]])):
        start = time.perf_counter()
        own, root = simhash.linked_in_run(np.unique(fps))
        assert time.perf_counter() - start < 60
        fps = np.unique(fps)
        # every link of a few hundred of them is kept, and no component is larger than its links make it
        for i in range(0, len(fps), max(1, len(fps) // 300)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= simhash.BITS)
            assert (root[near] == root[i]).all()
        lone = np.flatnonzero(np.bincount(root, minlength=len(fps))[root] == 1)[:200]
        assert all((np.bitwise_count(fps ^ fps[i]) <= simhash.BITS).sum() == 1 for i in lone)


def test_deduplicated_with_columns_of_any_type(spark):
    rows = [(1, "a b c", {"k": 2}, b"x"), (1, "a b c", {"k": 1}, b"x"), (2, "A b c", {"k": 0}, None), (None, "d e f g", None, b"y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, raw binary").withColumn("v", F.parse_json(F.lit('{"z": 1}')))
    got = simhash.deduplicated(d)
    assert got.dtypes == d.dtypes and sorted((r.doc_id or 0, r.extra) for r in got.drop("v").collect()) == [(0, None), (1, {"k": 1})]
    same = d.unionByName(d)
    assert simhash.deduplicated(same).count() == 2


def test_near_duplicate_rows(spark):
    d = docs_of(spark, [*EDGES, "same  TEXT here"], [9, 8, 7, 6, 5, 4, 4, None])
    got = simhash.near_duplicates(d).collect()
    assert len(got) == 8
    by = {(r.doc_id, r.text_key): r.component_id for r in got}
    assert {c for (i, _), c in by.items() if i in (4, None)} == {4} and {c for (i, _), c in by.items() if i in (8, 9)} == {8}
    kept = simhash.deduplicated(d)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8] and kept.columns == d.columns
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0 and simhash.deduplicated(docs_of(spark, [])).count() == 0


def test_long_chains_join(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 701), (701, 700)], "a long, b long")
    got = {r.node: r.root for r in components.connected(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 701: 700}
    assert components.connected(links.where("false")).count() == 0


# languages
def test_language_held_out_accuracy(spark):
    got = queries.op10_bitmask_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_filters_return_all_languages(spark):
    rows = [("en", "the cat and the dog " * 20), ("de", "der hund und die katze " * 20), ("xx", "the hund " * 40), (None, "zzz")]
    filters = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert filters.languages == ["de", "en", "xx"]
    one, two = langid._rows(langid._codes(b" the"), (len(filters.rows) - 1).bit_length())
    mask = int((filters.rows[one, 0] & filters.rows[two, 0])[0])
    assert mask == 0b110  # en and xx contain it
    d = docs_of(spark, ["the dog", "die katze", "12 34", "É", *EDGES]).withColumn("score", F.lit("old"))
    got = langid.identify(d, filters).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["en", "de", "und"] and got[3].lang_pred != "und" and [r.lang_pred for r in got[4:7]] == ["und"] * 3
    assert len(got) == 4 + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    empty = langid.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in langid.identify(d, empty).collect()} == {"und"}
    assert langid.identify(d.where("false"), filters).count() == 0


def brute_model(rows, share, relative):
    """language -> the n-grams that it contains."""
    counts: dict = {}
    for lang, text in rows:
        if lang is not None:
            data = langid._normal(text)
            data = data.ljust(4)
            own = counts.setdefault(lang, {})
            for i in range(len(data) - 3):
                own[data[i : i + 4]] = own.get(data[i : i + 4], 0) + 1
    shares = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    most: dict = {}
    for own in shares.values():
        for g, p in own.items():
            most[g] = max(most.get(g, 0), p)
    return {lang: {g for g, p in own.items() if p >= share and p >= relative * most[g]} for lang, own in shares.items()}


def test_filters_and_scores_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in d.collect()]
    want = brute_model(rows, langid.SHARE, langid.RELATIVE)
    counts = langid.gram_counts(d, "lang", "text")
    # texts of one batch are set apart by spaces, which n-grams of the brute force don't reach over
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    got: dict = {}
    for r in langid.contained(counts, totals).collect():
        got.setdefault(r.lang, set()).add(int(r.gram).to_bytes(4, "little"))
    for lang, own in want.items():
        assert len(own ^ got[lang]) <= 0.02 * len(own)
    filters = langid.fit(d)
    for r in langid.identify(d, filters).collect():
        data = langid._normal(r.text).ljust(4)
        grams = [data[i : i + 4] for i in range(len(data) - 3)]
        share = {lang: sum(g in own for g in grams) / len(grams) for lang, own in got.items()}
        if any(c.isalpha() for c in r.text or ""):
            assert abs(r.score - max(share.values())) < 0.05 and share[r.lang_pred] >= max(share.values()) - 0.05


def test_rare_languages_are_learned(spark):
    rows = [("xx", "Ab")]
    d = docs_of(spark, ["Ab", "something else", "12", None])
    got = langid.identify(d, langid.fit(spark.createDataFrame(rows, "lang string, text string"))).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["xx", "xx", "und", "und"]
    rows = [("en", "the cat and the dog " * 5_000), ("xx", "qua zor"), ("yy", None), ("zz", "")]
    filters = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert filters.languages == ["en", "xx", "yy", "zz"]
    assert [r.lang_pred for r in langid.identify(docs_of(spark, ["qua zor", "the dog"]), filters).orderBy("doc_id").collect()] == ["xx", "en"]


def test_a_language_of_hundreds_of_thousands_of_ngrams(spark):
    rnd = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(rnd.choice(letters, n))
    rows = [(i, word(14_000), "s", "big") for i in range(64)] + [(100 + i, "small words of a small language " * 3, "s", "small") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    filters = langid.fit(df)
    grams = len({g for _, t, _, lang in rows if lang == "big" for g in langid._codes(langid._normal(t)).tolist()})
    assert grams > 262_144 and len(filters.rows) >= 4 * grams  # as many rows as the n-grams ask for, whatever their number
    assert max(filters.fill) < 0.4
    own = np.unique(np.concatenate([langid._codes(langid._normal(t)) for _, t, _, lang in rows if lang == "big"]))
    other = np.setdiff1d(rnd.integers(0, 1 << 32, 200_000, dtype=np.uint32), own)
    one, two = langid._rows(other, (len(filters.rows) - 1).bit_length())
    bit = np.uint64(filters.languages.index("big"))
    passed = float(((filters.rows[one, 0] & filters.rows[two, 0]) >> bit & np.uint64(1)).mean())
    assert passed == pytest.approx(filters.fill[int(bit)] ** 2, abs=0.01) and passed < 0.17
    assert langid.identify(spark.createDataFrame([(1, word(50)), (2, "a small language")], "doc_id long, text string"), filters).select("lang_pred").collect() == [("big",), ("small",)]


def test_filter_rows_follow_the_fullest_slice():
    # At the bound that SHARE sets, a million n-grams, a slice is no fuller than below it.
    for grams in (1_000, 262_144, 300_000, 1_000_000):
        log_rows = max(langid.LOG_ROWS, (4 * grams - 1).bit_length())
        codes = np.random.default_rng(grams).choice(1 << 32, grams, replace=False) if grams < 2_000 else np.arange(grams, dtype=np.uint64) * 4001 % (1 << 32)
        held = np.zeros(1 << log_rows, dtype=bool)
        for r in langid._rows(codes.astype(np.uint32), log_rows):
            held[r] = True
        assert held.mean() < 0.4


def test_many_languages(spark):
    rows = [(f"l{i:03d}", f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i % 26)} " * 30) for i in range(70)]
    filters = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    got = langid.identify(docs_of(spark, [t for _, t in rows]), filters).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == [lang for lang, _ in rows]
