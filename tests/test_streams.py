"""Streams into tables: three batches, a restart and a batch query must agree; evidence of extracted fields."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evidence, extract, merge
from ledgerlens.plans.builtin import INVOICE
from ledgerlens.plans.schema import Field, Schema
from ledgerlens.streaming import cases, logs
from ledgerlens.streaming.tables import latest, run_to_table

COLUMNS = "case_id string, doc_index int, field string, value string, confidence double, has_detail boolean"


def case_rows(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        detail = rnd.random() < 0.7
        out.append((rnd.choice(["a", "b", "hot", "hot", None]), i, rnd.choice(["x", "y"]), rnd.choice([None, "1", "2", "3"]), rnd.choice([None, 0.2, 0.5, 0.5]) if detail else None, detail))
    rnd.shuffle(out)  # documents arrive in any order
    return out


def test_cases_merged_as_they_arrive(spark, tmp_path):
    rows = case_rows(3, 120)
    table, seen = f"file://{tmp_path}/table", []
    for batch in range(3):
        own = rows[batch * 40 : (batch + 1) * 40]
        spark.createDataFrame(own, COLUMNS).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        seen += own
        # Each call is a new run of the stream, so that it starts again from its notes.
        got = cases.merge_arrived(spark, spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in"), path=table)
        want = merge.fold_fields(spark.createDataFrame(seen, COLUMNS))
        cols = ["case_id", "field", "from_doc_index", "value", "confidence"]
        assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, map(tuple, want.select(cols).collect())))
    again = cases.merge_arrived(spark, spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in"), path=table)
    assert again.count() == got.count()  # nothing new arrived


def test_merge_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none")
    assert cases.merge_arrived(spark, spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/none")).collect() == []


def test_a_repeated_batch_counts_once(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double").write.parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/t"
    stream = logs.group_stream(spark.readStream.schema("k string, v double").parquet(f"{tmp_path}/in"), "k", "v", 2.0)
    run_to_table(stream, path)
    changes = spark.read.parquet(f"{path}/changes/n=0")
    changes.write.mode("overwrite").parquet(f"file://{tmp_path}/copy")
    spark.read.parquet(f"file://{tmp_path}/copy").write.mode("overwrite").parquet(f"{path}/changes/n=0")  # what a failed and repeated batch does
    spark.createDataFrame([("a", 5.0), (None, 1.0)], "k string, v double").write.mode("append").parquet(f"{tmp_path}/in")
    run_to_table(stream, path)
    got = {r.k: (r.n, r.n_valid, r.avg_value) for r in latest(spark, path, ["k"], stream.schema).collect()}
    assert got == {"a": (2, 1, 3.0), "b": (1, 1, 3.0), None: (1, 0, 1.0)}


def test_windowed_groups(spark, tmp_path):
    rows = [("2026-01-01 00:01:00", "a", 1.0), ("2026-01-01 00:09:00", "a", 3.0), ("2026-01-01 00:11:00", "a", 5.0), (None, "a", 9.0)]
    spark.createDataFrame(rows, "t string, k string, v double").select(F.col("t").cast("timestamp").alias("t"), "k", "v").write.parquet(f"{tmp_path}/in")
    stream = logs.windowed_stream(spark.readStream.schema("t timestamp, k string, v double").parquet(f"{tmp_path}/in"), "t", "k", "v")
    run_to_table(stream, f"file://{tmp_path}/t")
    got = latest(spark, f"file://{tmp_path}/t", ["window", "k"], stream.schema).orderBy("window").collect()
    assert [(r.n, r.avg_value) for r in got] == [(2, 2.0), (1, 5.0)]


def test_best_pieces(spark):
    letters = lambda texts: [[float(t.count(x)) for x in "aeo"] for t in texts]
    q = spark.createDataFrame([("d", "f", "aaa"), ("d", "g", " "), (None, "f", "eee"), ("none", "f", "a"), ("e", "f", "o")], "doc_id string, field string, question string")
    p = spark.createDataFrame([("d", 0, "c1", "aa", 1), ("d", 1, "c2", "aaa", 2), ("d", 2, "c3", "aaa", 3), (None, 0, "c1", "e", None), ("e", 0, "c1", "", None)], "doc_id string, position int, id string, text string, page int")
    got = {(r.doc_id, r.field, r["rank"]): (r.id, r.page) for r in evidence.best_pieces(q, p, letters, ["doc_id"], 2).collect()}
    assert got == {("d", "f", 1): ("c2", 2), ("d", "f", 2): ("c3", 3), (None, "f", 1): ("c1", None), ("e", "f", 1): ("c1", None)}
    assert evidence.best_pieces(q.limit(0), p, letters, ["doc_id"]).collect() == []


def test_evidence_of_provided_fields(spark):
    docs = spark.createDataFrame([(1, ["first page says nothing at all here", "emisor acme con mucha informacion util"]), (2, None)], "doc_id int, pages array<string>")
    docs = docs.withColumn("text", F.coalesce(F.array_join("pages", "\n"), F.lit("unas palabras sueltas que nadie mas ha escrito")))
    schema = Schema("s", fields=(Field("emisor", "string"), Field("otro", "string")))
    provider = lambda d: d.withColumn("provided", F.lit('{"Emisor": "acme"}'))
    vectors = lambda texts: [[float("emisor" in t), float("acme" in t)] for t in texts]
    got = {r.doc_id: r for r in extract.extract(docs, schema, pages_col="pages", provider=provider, vectors=vectors, keys=["doc_id"]).collect()}
    d = got[1].details["emisor"]
    assert (got[1].emisor, d.confidence, d.page) == ("acme", 0.55, 2) and d.evidence.startswith("emisor acme")
    assert got[2].details["emisor"].page == 1 and got[2].details["emisor"].evidence.startswith("unas palabras")
    assert "otro" not in got[1].details  # nobody gave it
    with pytest.raises(ValueError, match="keys"):
        extract.extract(docs, schema, provider=provider, vectors=vectors)


def test_movements_answer_a_schema_of_expenses(spark):
    text = "Transferencia enviada\nAlquiler\n-650,00\nPago tarjeta\n31,21\nSaldo disponible en la cuenta"
    docs = spark.createDataFrame([(text,), ("una carta con palabras de sobra para leer y ninguna cifra",)], "text string")
    schema = Schema("credito_hipotecario", fields=(Field("total_gastos_mensuales", "number"),))
    asked = []
    provider = lambda d: asked.append(1) or d.withColumn("provided", F.lit('{"total_gastos_mensuales": "5"}'))
    a, b = sorted(extract.extract(docs, schema, provider=provider).collect(), key=lambda r: r.backend)
    assert (a.backend, float(a.total_gastos_mensuales), a.details["total_gastos_mensuales"].confidence) == ("heuristic", 681.21, 0.7)
    assert (b.backend, b.total_gastos_mensuales) == ("provider", "5") and asked


def test_phrases_do_not_count_as_prefilled(spark):
    docs = spark.createDataFrame([("Comparecen D./Dña. Ana Ruiz, con DNI 12345678Z y a 2026-01-02 firman",)], "text string")
    from ledgerlens.plans.builtin import MORTGAGE

    r = extract.extract(docs, MORTGAGE).first()
    given = [f.name for f in MORTGAGE.fields if r[f.name] is not None]
    assert len(given) > r.n_prefilled
    assert extract.extract(docs, INVOICE).first().n_prefilled >= 0
