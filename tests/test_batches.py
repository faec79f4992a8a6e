"""Many schemas in one plan, stores that count batches once, counted writes and guarded calls."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.normalize import RAW
from ledgerlens.operators.validate import constraint_rows, validate, validate_many
from ledgerlens.plans.builtin import IDENTITY, INVOICE, MORTGAGE
from ledgerlens.plans.schema import Constraint, Field, Schema
from ledgerlens.sources import counted, store


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


MIXED = Schema("mixed", fields=(
    Field("n", "number", True, None, (Constraint("min", 1.0), Constraint("max", 5.0), Constraint("enum", (2, 3, 9)))),
    Field("i", "integer"), Field("b", "boolean", True), Field("d", "date"), Field("t", "datetime"),
    Field("s", "string", True, None, (Constraint("regex", "[A-Z]+"), Constraint("enum", ("AB", "C")))),
))
VALUES = [
    {"n": "2", "i": "4", "b": "true", "d": "2026-01-02", "t": "2026-01-02T10:00:00", "s": "AB"}, {"n": "9", "i": "4.5", "b": "si", "d": "02/01/2026", "t": "x", "s": "abc"},
    {"n": "0.5", "i": "", "b": None, "s": "C\n"}, {"n": "x", "i": "4.0", "b": "false", "s": " "}, {}, None,
]


def test_many_schemas_agree_with_one(spark):
    schemas = [MIXED, INVOICE, IDENTITY, MORTGAGE]
    kind = "map<string,string>"
    records = spark.createDataFrame([(k, s.name, v) for s in schemas for k, v in enumerate(VALUES)], f"k int, schema string, values {kind}")
    got = {(r.k, r.schema): ([tuple(i) for i in r.issues], r.valid, r.verdicts) for r in validate_many(records, constraint_rows(spark, schemas)).collect()}
    for s in schemas:
        wide = records.where(F.col("schema") == s.name).select("k", *[F.col("values")[f.name].alias(f.name) for f in s.fields])
        # Booleans and numbers are typed before they are validated, with the text beside them; the rest are texts.
        typed = {f.name: {"boolean": "boolean", "integer": "bigint", "number": "double"}[f.type] for f in s.fields if f.type in ("boolean", "integer", "number")}
        wide = wide.withColumns({RAW + n: F.col(n) for n in typed}).withColumns({n: F.col(n).try_cast(k) for n, k in typed.items()})
        for r in validate(wide, s).collect():
            issues, valid, verdicts = got[r.k, s.name]
            assert [i for i in issues if not (i[1] == "b" and i[2] == "type")] == [tuple(i) for i in r.issues if not (i.field == "b" and i.code == "type")], (s.name, r.k)
            assert sum(v.bit_count() for v in verdicts) == len(issues) and valid == (not issues)


def test_a_thousand_schemas_in_one_plan(spark):
    many = [Schema(f"s{i}", fields=(Field("a", "number", False, None, (Constraint("min", float(i)),)), *[Field(f"f{j}", required=j == i % 40) for j in range(40)])) for i in range(1000)]
    records = spark.createDataFrame([(i, f"s{i}" if i < 1000 else [None, "unknown"][i % 2], {"a": "500"}) for i in range(1002)], "k int, schema string, values map<string,string>")
    one, all_ = (validate_many(records, constraint_rows(spark, s)) for s in (many[:1], many))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString().split("\n"))
    assert size(one) == size(all_)
    for r in all_.collect():
        if r.k >= 1000:
            assert (r.issues, r.valid, r.verdicts) == ([], False, None)
            continue
        want = (["min"] if r.k > 500 else []) + ["required"]
        assert [i.code for i in r.issues] == want and len(r.verdicts) == 2  # 3 + 80 checks
    assert validate_many(records.limit(0), constraint_rows(spark, many[:1])).collect() == []


def test_stores_count_a_batch_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert store.read_store(spark, path, schema="doc_id long, text string").collect() == []
    with pytest.raises(ValueError, match="no batch"):
        store.read_store(spark, path)
    assert store.append_batch(batch([(1, "a"), (1, "a2"), (None, "n"), (2, None)]), path)
    assert not store.append_batch(batch([(2, None), (None, "n"), (1, "a2"), (1, "a")]).repartition(3), path)
    assert store.append_batch(batch([(2, "later"), (3, "c"), (None, "n")]), path)
    want = [(1, "a"), (1, "a2"), (2, None), (3, "c"), (None, "n"), (None, "n")]
    assert sorted(map(repr, map(tuple, store.read_store(spark, path).collect()))) == sorted(map(repr, want))
    assert store.append_batch(batch([]), path) and not store.append_batch(batch([]), path)
    assert store.read_store(spark, path).count() == 6


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    path, gate, done = f"file://{tmp_path}/store", threading.Barrier(2), []
    commit = store._commit

    def together(*args):
        gate.wait(60)  # both have written their rows and neither has committed
        return commit(*args)

    monkeypatch.setattr(store, "_commit", together)
    threads = [threading.Thread(target=lambda: done.append(store.append_batch(spark.range(20).withColumnRenamed("id", "doc_id"), path))) for _ in range(2)]
    [x.start() for x in threads]
    [x.join(120) for x in threads]
    assert sorted(done) == [False, True] and store.read_store(spark, path).count() == 20


def test_a_wrong_count_names_the_file(spark, tmp_path):
    rows = spark.range(239).select(F.when(F.col("id") < 120, "a.csv").otherwise("b.csv").alias("file"), "id")
    assert counted.write_counted(rows, f"file://{tmp_path}/ok", {"a.csv": 120, "b.csv": 119}, "file") == {"a.csv": 120, "b.csv": 119}
    with pytest.raises(counted.WrongCount, match="b.csv: 119 rows for 120"):
        counted.write_counted(rows, f"file://{tmp_path}/bad", {"a.csv": 120, "b.csv": 120}, "file")
    assert not (tmp_path / "bad").exists()
    with pytest.raises(counted.WrongCount, match="119 rows of others"):
        counted.write_counted(rows, f"file://{tmp_path}/more", {"a.csv": 120}, "file")
    assert counted.write_counted(rows.limit(0), f"file://{tmp_path}/none", {"a.csv": 0}, "file") == {"a.csv": 0}


def test_guarded_calls(spark, tmp_path):
    def call(text):
        import time

        if text == "slow":
            time.sleep(30)
        if text == "bad":
            raise KeyError("gone")
        return None if text == "nothing" else text.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "slow"), (3, "bad"), (4, None), (5, ""), (6, "nothing"), (7, "z")], "id int, text string").coalesce(1)
    fine, dead = counted.with_dead_letters(rows, f"file://{tmp_path}/first", "text", call, seconds=1.0)
    assert sorted((r.id, r.answer) for r in fine.collect()) == [(1, "A"), (4, None), (5, ""), (6, None), (7, "Z")]
    assert sorted((r.id, r.answer, r.failure) for r in dead.collect()) == [(2, None, "timeout"), (3, None, "KeyError: 'gone'")]
    fine, dead = counted.ask_again(dead, f"file://{tmp_path}/again", "text", lambda t: t * 2)
    assert sorted((r.id, r.answer) for r in fine.collect()) == [(2, "slowslow"), (3, "badbad")] and dead.count() == 0
    assert counted.guarded(rows.limit(0), "text", call).collect() == []
