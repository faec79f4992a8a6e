import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.repair import degraded, document_seed
from ledgerlens.operators import experiments, extract, merge, metrics, retrieve, stats
from ledgerlens.plans.builtin import IDENTITY, INVOICE, MORTGAGE
from ledgerlens.sources import providers, readers, writers
from ledgerlens.streaming import logs


def test_merge_prefers_confidence(spark):
    rows = spark.createDataFrame([("c", 0, "f", "a", None), ("c", 1, "f", "b", 0.5), ("c", 2, "f", "x", 0.5), ("c", 3, "f", None, 0.9), ("c", 0, "g", None, None)], "case_id string, doc_index int, field string, value string, confidence double")
    got = {r.field: (r.value, r.from_doc_index) for r in merge.merge_fields(rows).collect()}
    assert got == {"f": ("b", 1), "g": (None, 0)}
    folded = {r.field: r.value for r in merge.fold_fields(rows.withColumn("has_detail", F.lit(True))).collect()}
    assert folded["f"] == "b"
    filled = merge.fill_missing(merge.merge_fields(rows), INVOICE).where("case_id = 'c'")
    assert filled.count() == len(INVOICE.fields)


def test_key_matching(spark):
    pred = spark.createDataFrame([(1, "Num Factura", "x"), (1, "num_factura", "y"), (1, "otro", "z")], "doc_id int, field string, value string")
    names = spark.createDataFrame([("num_factura",)], "field string")
    assert [(r.field, r.value) for r in merge.match_keys(pred, names).collect()] == [("num_factura", "y")]


def test_metrics_kinds(spark):
    cols = "d int, field string, value string, number double"
    truth = spark.createDataFrame([(1, "a", "x", None), (1, "b", "1.0", 1.0), (1, "c", "", None), (1, "e", "q", None), (1, "n", None, None)], cols)
    pred = spark.createDataFrame([(1, "a", " X ", None), (1, "b", "1.005", 1.005), (1, "c", "z", None), (1, "extra", "z", None), (1, "n", "", None)], cols)
    c = {r.field: (r.equal, r.kind) for r in metrics.compare_by_truth(pred, truth, ["d"]).collect()}
    assert c == {"a": (True, None), "b": (True, None), "c": (False, "spurious"), "e": (False, "miss"), "n": (False, "other")}
    m = metrics.field_metrics(metrics.compare_by_truth(pred, truth, ["d"]), ["d"]).first()
    assert (m.exact_matches, m.fields_gt_present, m.fields_pred_present, m.document_correct) == (2, 3, 3, False)


def test_summary_adds_missing_groups(spark):
    rows = spark.createDataFrame([(True, 1.0, 1.0, 2.0, 1.0, 1, 1, 1, "x")], "document_correct boolean, f1 double, match_rate double, latency_s double, ram_peak_mb double, exact_matches long, fields_pred_present long, fields_gt_present long, k string")
    s = metrics.with_all_keys(metrics.summarize(rows, ["k"]), "k", ["x", "y"])
    assert {(r.grouping, r.key): r.runs for r in s.collect()} == {("overall", None): 1, ("k", "x"): 1, ("k", "y"): 0}


def test_config_statistics_needs_three_runs(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0)], "config string, m double")
    r = stats.config_statistics(runs, "config", ["m"]).first()
    assert (r.m_mean, r.m_sd, r.m_range) == (2.0, 1.0, 2.0) and r.m_ci95_high == pytest.approx(2 + 4.3026527299 / 3**0.5)
    with pytest.raises(Exception, match="3 runs"):
        stats.config_statistics(runs.limit(2), "config", ["m"]).collect()


def test_names(spark):
    df = spark.createDataFrame([("x/03_seed20260501_C1_auto.csv", "a/SCANNED_BLURRY_PDF_1.PDF", "IRPF_2.jpg")], "run string, file string, image string")
    r = df.select(experiments.run_id(F.col("run")).alias("r"), experiments.variant_of(F.col("file")).alias("v"), experiments.input_kind(F.col("image")).alias("k"), experiments.family_of(F.col("image")).alias("f"), experiments.file_type(F.col("file")).alias("t")).first()
    assert (r.r.number, r.r.seed, r.r.label, r.v, r.k, r.f, r.t) == (3, 20260501, "C1_auto", "scanned_blurry_pdf", "image", "IRPF", "scanned_pdf")


def test_case_lifecycle(spark):
    cases = spark.createDataFrame([("1", "s", "native_pdf", True, "pending", "f1", "t1"), ("2", "s", "image_photo", False, None, "f2", "t2")], "case_id string, schema_name string, variant string, compliance_expected boolean, status string, file_path string, truth_path string")
    files = spark.createDataFrame([("f1",), ("t1",), ("f2",)], "path string")
    assert [r.case_id for r in experiments.ready_candidates(cases, files).collect()] == ["1"]
    assert {r.case_id: r.status for r in experiments.mark_ready(cases, "1").collect()} == {"1": "ready", "2": None}
    with pytest.raises(Exception, match="no case"):
        experiments.mark_ready(cases, "9").collect()
    assert [r.case_id for r in experiments.review_queue(cases).collect()] == ["2"]
    assert experiments.status_counts(cases).first().n_pending == 2
    assert experiments.advance(cases, "copy", F.lit(True)).where("status = 'copied'").count() == 2


def test_extraction(spark):
    t = "Emisor: Mesa S.L.\nNIF A2418382A FAC-2026-0001 2026-03-25\nBase imponible: 2.445,37\nTipo IVA: 4%\nCuota IVA: 97,81\nTotal: 2.543,18"
    df = spark.createDataFrame([(1, t), (2, "nada que ver aqui con suficientes letras")], "doc_id int, text string")
    got = {r.doc_id: r for r in extract.extract(df, INVOICE).collect()}
    assert (got[1].razon_social_emisor, got[1].nif_emisor, float(got[1].base_imponible), got[1].tipo_iva) == ("Mesa S.L.", "A2418382A", 2445.37, "4")
    assert got[1].n_prefilled == 1 and got[2].n_prefilled == 0  # the NIF by its pattern; what phrases gave does not count
    provide = lambda d: d.withColumn("provided", F.create_map(F.lit("num_factura"), F.lit("P")))
    got = {r.doc_id: (r.backend, r.num_factura) for r in extract.extract(df, INVOICE, provider=provide).collect()}
    assert got == {1: ("provider", "P"), 2: ("provider", "P")}  # under five prefilled fields
    k = spark.createDataFrame([("Nombre: Ana\nPrimer apellido: Gil\n12345678Z 1990-01-02 y 2030-01-02",)], "text string")
    r = extract.extract(k, IDENTITY).first()
    assert (r.nombre_titular, r.fecha_nacimiento, r.fecha_caducidad) == ("Ana", "1990-01-02", "2030-01-02")
    m = spark.createDataFrame([("Comparecen D./Dña. Ana Gil, con DNI 12345678Z, un capital de 157.520,60 Euros al 3,6 % anual", "contrato_hipoteca_esp_0007.pdf")], "text string, name string")
    r = extract.extract(m, MORTGAGE, name_col="name").first()
    assert (r.nombre_cliente, r.monto_prestamo_eur, r.tasa_interes, r.id_documento) == ("Ana Gil", "157520.6", "3.6", "HIP-0007")


def test_noisy_lines(spark):
    lines = ["HP-0001", "DNI: 864732I2N", "2025-03-08", "Plazo 252 meses", "CU: 762.6O EUR", "RATO: 0.39", "TAE: 4.44 %", "FEIN: ok", "FIAE", "SIST: frances"]
    r = extract.from_noisy_lines(spark.createDataFrame([("\n".join(lines),)], "text string")).first()
    assert (r.id_documento, r.dni_cliente, r.fecha_emision, r.plazo_meses) == ("HIP-0001", "86473212N", "2025-03-08", 252)
    assert (r.cuota_mensual_eur, r.ratio_endeudamiento, r.tae, r.fein_entregada, r.fiae_entregada, r.sistema_amortizacion) == (762.6, 0.39, 4.44, True, True, "frances")


def test_movements(spark):
    t = "Transferencia enviada\nAlquiler\n-650,00\nPago tarjeta\n31,21\nSaldo\n9.999,00"
    df = spark.createDataFrame([(t,), ("x",)], "text string")
    assert [r[0] for r in df.select(extract.total_of_movements(F.col("text"))).collect()] == [681.21, None]


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 5.0])], "id long, vector array<float>")
    q = rows.where("id = 1").withColumnRenamed("id", "query_id")
    assert [(r.rank, r.id) for r in retrieve.nearest(q, rows, 2).orderBy("rank").collect()] == [(1, 2), (2, 3)]
    pages = spark.createDataFrame([(1, 1, "alpha " * 300), (1, 2, "  ")], "doc_id int, page int, text string")
    assert [r.id for r in retrieve.page_chunks(pages).collect()] == ["p1_c1", "p1_c2"]


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 128)
    points = {i: [float(i * i % 17), float(i % 5)] for i in range(30)}
    rows = spark.createDataFrame(list(points.items()), "id long, vector array<float>")
    got = retrieve.nearest(rows.withColumnRenamed("id", "query_id"), rows, 3).collect()
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(points[a], points[b], strict=True)) ** 0.5
    want = {q: sorted((distance(q, i), i) for i in points if i != q)[:3] for q in points}
    assert {q: [(r.distance, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in points} == want


def test_reader_cascade(spark):
    docs = spark.createDataFrame([(b"this is a good and long enough text to keep",), (b"x",)], "content binary")

    def fails(b):
        raise RuntimeError

    found = providers.read_texts(docs, [providers.TextProvider("embedded", providers.utf8), providers.TextProvider("ocr", lambda b: "words that the second reader saw in the scan"), providers.TextProvider("vision", fails)])
    assert sorted(r.method for r in found.collect()) == ["embedded", "ocr"]
    assert [r.method for r in providers.read_texts(docs, [providers.TextProvider("vision", fails)], "vlm_only").collect()] == ["vision_failed"] * 2
    assert providers.Options.mode(None, "bad", "ocr_only") == "ocr_only"


def test_files(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/a_ground_truth.json").write_text(json.dumps({"num_factura": "F1", "base_imponible": 10, "tipo_iva": 4}))
    (tmp_path / "docs/native_pdf").mkdir(parents=True)
    (tmp_path / "docs/native_pdf/a.pdf").write_bytes(b"pdf")
    (tmp_path / "docs/native_pdf/b.pdf").write_bytes(b"pdf")
    docs = readers.documents(spark, str(tmp_path / "docs"), ["native_pdf"])
    pair = readers.paired(docs, readers.truths(spark, str(tmp_path / "gt"), INVOICE)).collect()
    assert [(r.name, r.num_factura, r.base_imponible) for r in pair] == [("a.pdf", "F1", 10.0)]
    (tmp_path / "logs").mkdir()
    for i in range(3):
        (tmp_path / f"logs/2024{i}.json").write_text(json.dumps({"file_name": "a.pdf", "extracted_fields": {"num_factura": "F1", "x": ""}, "full_result": {"validation": {"valid": i > 1, "issues": [{"level": "error", "field": "f", "code": "c", "message": "m"}]}}}))
    (tmp_path / "logs/2023.json").write_text("{broken")
    found = readers.execution_logs(spark, str(tmp_path / "logs"), 2)
    assert [(r.log, r.valid, r.fields_filled, r.n_issues) for r in found.orderBy("log").collect()] == [("20241.json", False, 1, 1), ("20242.json", True, 1, 1)]
    assert readers.log_issues(found).count() == 2 and readers.log_fields(found).where("key = 'a'").count() == 4
    assert readers.execution_logs(spark, str(tmp_path / "logs"), 9).count() == 3
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('[{"field": "x"}]')
    (tmp_path / "m/b.json").write_text('{"field_mismatches": [{"field": "y"}, {"field": "x"}]}')
    assert readers.mismatches(spark, str(tmp_path / "m")).groupBy("field").count().where("field = 'x'").first()["count"] == 2
    out = str(tmp_path / "out")
    writers.write_csv(spark.createDataFrame([('say "hi"', 1)], "a string, b int"), out, True)
    assert spark.read.option("header", True).option("escape", '"').csv(out).first().a == 'say "hi"'
    with pytest.raises(ValueError):
        writers.markdown_table(spark.range(3), 2)


def test_degraded_column(spark):
    df = spark.createDataFrame([("a" * 600, "ff")], "t string, h string").withColumn("s", document_seed(F.sha2("t", 256), 5))
    assert len(df.select(degraded(F.col("t"), F.col("s"))).first()[0]) > 590


def test_stream(spark, sf):
    got = logs.group_once(spark, sf, "events.parquet", "event_type", "value", 20.0)
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_pairing_has_one_sided_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert sorted(map(tuple, stats.pairing(a, b, "k").collect())) == [(1, "left"), (2, "both"), (3, "right")]


def test_provided_json_is_matched_to_names(spark):
    df = spark.createDataFrame([(1, "uno dos tres cuatro cinco seis")], "doc_id int, text string")
    provide = lambda d: d.withColumn("provided", F.lit('{"Num-Factura": "P", "other": 3}'))
    r = extract.extract(df, INVOICE, provider=provide).first()
    assert (r.backend, r.num_factura, r.nif_emisor) == ("provider", "P", None)
    assert r.details["num_factura"].confidence == extract.PREFILL_CONFIDENCE and set(r.details) == {"num_factura"}
    empty = df.select(extract.all_empty(["text"]).alias("a"), extract.all_empty([]).alias("b")).first()
    assert (empty.a, empty.b) == (False, True)


def test_rule_outcomes_of_broken_reports(spark):
    reports = [(1, '{"decision_rules": [{"id": "", "expresion": " e ", "cumple": null}, {"descripcion": "d", "cumple": 1}, {"id": "x", "cumple": true}, {"id": "x", "cumple": false}]}'), (2, "no json"), (3, None), (4, '{"json": {}, "decision_rules": [{"id": "y"}]}')]
    got = metrics.rule_outcomes(spark.createDataFrame(reports, "k int, report string"), ["k"]).collect()
    assert sorted((r.k, r.rule_id, r.holds) for r in got) == [(1, "d", None), (1, "e", None), (1, "x", False)]
