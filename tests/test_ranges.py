"""Orders over all rows, exact quantiles and neighbours, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import engine, ranges, retrieve, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_running_totals(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 1.0, 2.5, -3.0]), rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v double, g int").repartition(7)
    order = [F.col("g"), F.desc("id")]
    want = sorted(rows, key=lambda r: (r[2], -r[0]))
    got = {r.id: r.n for r in ranges.numbered(df, order).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(want)}
    total, sums = None, {}
    for i, v, _ in want:
        total = total if v is None else (total or 0) + v
        sums[i] = total
    assert {r.id: r.s for r in ranges.running_totals(df, {"s": F.col("v")}, order).collect()} == pytest.approx(sums)
    assert ranges.numbered(df.limit(0), order).collect() == [] and ranges.running_totals(df.limit(0), {"s": F.col("v")}, order).collect() == []


def test_running_mean_without_a_key_has_no_single_partition(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(100)], "id long, v double").repartition(5)
    got = stats.progress(df, "v", ["id"])
    assert "SinglePartition" not in plan(stats.running_mean(df, "v", ["id"]))
    seen = []
    for r in got.orderBy("id").collect():
        seen += [r.id] if r.id % 4 else []
        assert (r.running_v, r.running_n, r.n_left) == (pytest.approx(sum(seen) / len(seen)) if seen else None, r.id + 1, 99 - r.id)
        assert r.eta_v == (pytest.approx(r.running_v * r.n_left) if seen else None)
    assert stats.progress(df.limit(0), "v", ["id"]).collect() == []


@pytest.mark.parametrize("by", [[], ["k"], ["k", "k2"]])
def test_order_statistics(spark, by):
    rnd = random.Random(len(by))
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(2), rnd.choice([None, *range(40)])) for _ in range(600)] + [("c", 0, None), ("d", 1, 7)]
    df = spark.createDataFrame(rows, "k string, k2 int, v int").repartition(5)
    n = F.col("_n")
    got = stats.order_statistics(df, by, "v", {"first": F.lit(1), "mid": F.floor((n + 1) / 2), "last": n, "none": n + 1, "zero": F.lit(0)})
    groups = {}
    for k, k2, v in rows:
        if v is not None:
            groups.setdefault(tuple({"k": k, "k2": k2}[c] for c in by), []).append(v)
    want = {k: (len(v), *(sorted(v)[i] for i in (0, (len(v) + 1) // 2 - 1, len(v) - 1)), None, None) for k, v in groups.items()}
    assert {tuple(r[: len(by)]): tuple(r[len(by) :]) for r in got.collect()} == want
    assert "SinglePartition" not in plan(got)
    assert stats.order_statistics(df.limit(0), by, "v", {"x": F.lit(1)}).collect() == []


def distance(a, b):
    total = 0.0  # from left to right: sum() would compensate
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(queries, rows, k, same=False):
    usable = lambda v: v is not None and v and all(x is not None and abs(x) < float("inf") for x in v)
    out = {}
    for q, a in queries:
        if q is None or not usable(a):
            continue
        near = sorted((distance(a, b), r) for r, b in rows if r is not None and usable(b) and len(a) == len(b) and (same or r != q))
        out[q] = [(i + 1, r, d) for i, (d, r) in enumerate(near[:k])]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_metric_join_equals_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(retrieve, "HELD", held)  # in this process alone; tasks keep the module's value
    rnd = random.Random(4)
    centre = [[rnd.uniform(-50, 50) for _ in range(6)] for _ in range(12)]
    rows = [(i, [round(x + rnd.gauss(0, 1), 3) for x in centre[i % 12]]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, []), (None, rows[0][1]), (7, rows[7][1]), (3000, [1.0, 2.0]), (3001, [1.5, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    q = df.withColumnRenamed("id", "query_id")
    touched = spark.sparkContext.accumulator(0)
    got = {}
    for r in retrieve.nearest(q.dropDuplicates(["query_id"]), df, 4, touched=touched).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    first = {q: v for q, v in {i: v for i, v in reversed(rows)}.items()}
    assert {k: sorted(v) for k, v in got.items()} == brute(list(first.items()), rows, 4)
    assert touched.value < 0.5 * len(rows) ** 2  # clusters far apart are skipped
    assert retrieve.nearest(q.limit(0), df, 3).collect() == [] and retrieve.nearest(q, df.limit(0), 3).collect() == []


def test_thinning_keeps_the_nearest():
    import numpy as np

    rnd = np.random.default_rng(1)
    rows, q = rnd.normal(size=(300, 3)).round(1), rnd.normal(size=(7, 3)).round(1)
    cells = retrieve.Cells([[0.0, 0.0, 0.0]])
    scan = retrieve.Scan(cells, list(range(7)), q, np.full(7, np.inf), 5, True, True)
    order = np.argsort(cells.distances(rows)[:, 0], kind="stable")
    retrieve.HELD, old = 20, retrieve.HELD
    try:
        for at in range(0, 300, 50):
            part = order[at : at + 50]
            scan.add(3 * cells.most, part.tolist(), rows[part], cells.distances(rows[part])[:, 0])
    finally:
        retrieve.HELD = old
    own = scan.thin()
    want = brute(list(enumerate(q.tolist())), list(enumerate(rows.tolist())), 5, same=True)
    assert {i: list(zip(range(1, 6), own[own.q == i].r, own[own.q == i].d, strict=True)) for i in range(7)} == want


def test_kinds_of_case_files(spark):
    docs = [("a", "Tengo un pasaporte y una"), ("a", "HIPOTECA vigente"), ("b", "CIRBE incidencias factura"), ("c", "factura"), ("c", "pasaporte"), ("d", None), ("d", " "), ("e", "cuota"), ("f", "nota"), ("f", "simple"), (None, "irpf")]
    df = spark.createDataFrame(docs, "case_id string, text string")
    got = {r.case_id: r.schema_name for r in engine.case_kind(df).collect()}
    assert got == {"a": "credito_hipotecario", "b": "credito_hipotecario", "c": "kyc_onboarding", "d": "credito_hipotecario", "e": "auditoria_fiscal", "f": "credito_hipotecario", None: "credito_hipotecario"}
    assert engine.case_kind(df.limit(0)).collect() == []


def test_case_files_are_held_to_their_kind(spark):
    docs = [("a", 0, "Tengo un pasaporte"), ("a", 1, "hipoteca"), ("c", 0, "factura con iva total 121,00")]
    df = spark.createDataFrame(docs, "case_id string, doc_index int, text string")
    got = {r.case_id: (r.schema_name, r.status is not None) for r in engine.audit_case_files(df).collect()}
    assert got == {"a": ("credito_hipotecario", True), "c": ("auditoria_fiscal", True)}
