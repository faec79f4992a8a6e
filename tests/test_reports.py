import json

from pyspark.sql import functions as F

from ledgerlens.functions.text import first_of
from ledgerlens.operators import audit, experiments, readings, stats
from ledgerlens.plans.builtin import INVOICE
from ledgerlens.plans.schema import Constraint, Field, Schema, instructions
from ledgerlens.sources import writers


def runs_and_figures(spark):
    rows = [(c, s, 0.5 + 0.1 * i + 0.01 * s) for i, c in enumerate(("B", "A")) for s in (1, 2, 3)]
    runs = spark.createDataFrame(rows, "config_label string, seed int, f1_micro double")
    return runs, stats.config_statistics(runs, "config_label", ["f1_micro"])


def test_master_report(spark):
    runs, figures = runs_and_figures(spark)
    got = json.loads(writers.master_report(runs, figures, {"title": "t"}, names={"A": "First"}).first().json)
    assert got["meta"] == {"title": "t", "runs": 6, "configurations": 2}
    assert [(r["config_label"], r["seed"]) for r in got["per_run"]] == [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 2), ("B", 3)]
    assert (got["per_configuration"]["A"]["name"], got["per_configuration"]["B"]["name"], got["per_configuration"]["B"]["seeds"]) == ("First", "B", [1, 2, 3])
    empty = json.loads(writers.master_report(runs.limit(0), figures.limit(0), {}).first().json)
    assert empty["per_run"] == [] and empty["per_configuration"] == {}


def test_ablation_report(spark):
    _, figures = runs_and_figures(spark)
    text = writers.ablation_report(figures, ["B", "A"], {"F1": {"f1_micro": 3}}, "f1_micro", names={"A": "First"})
    lines = text.splitlines()
    assert lines[6].startswith("| B | 0.520 ± 0.025 [0.495, 0.545] |") and lines[7].startswith("| First | 0.620 ± ")
    assert "Best by f1_micro: First (0.6200); worst: B (0.5200); gap 0.1000." in text and "- First: Δ +0.1000 against B" in text


def test_report_files(spark, tmp_path):
    runs, figures = runs_and_figures(spark)
    writers.write_runs(runs, str(tmp_path / "runs"))
    writers.write_configurations(figures, str(tmp_path / "configs"), ["B", "A"])
    lines = next((tmp_path / "configs").glob("*.csv")).read_text().splitlines()
    assert [x.split(",")[0] for x in lines] == ["config_label", "B", "A"]
    assert next((tmp_path / "runs").glob("*.csv")).read_text().splitlines()[1].startswith("A,1,")
    cases = spark.createDataFrame([("b", None), ("a", "x")], "id string, path string")
    writers.write_text(writers.as_manifest(cases, {"country": "Espana"}), str(tmp_path / "m"))
    got = json.loads(next((tmp_path / "m").glob("*.txt")).read_text())
    assert got == {"country": "Espana", "test_cases": [{"id": "a", "path": "x"}, {"id": "b", "path": None}]}


def test_summary_rows(spark):
    form = "doc int, state string, valid boolean, issues array<string>, score double, rules array<struct<holds:boolean>>"
    rows = [(1, "CRITICO", False, ["a"], 0.5, [(False,), (True,), (None,)]), (2, "REVISAR", True, ["a", "b"], 0.5, []), (3, "OK", True, [], 1.0, [(True,)]), (4, "REVISAR", None, [], None, [])]
    got = {r.doc: r for r in audit.summary_rows(spark.createDataFrame(rows, form), ["doc"]).collect()}
    assert [got[i].reason for i in (1, 2, 3, 4)] == ["Fallo de regla critica", "2 incidencia(s)", "Validacion correcta", "Pendiente de revision"]
    assert (got[1].rules_ok, got[1].rules_total, got[1].state_text) == (1, 3, "CRITICO - Regla critica")


def test_runnable_cases(spark):
    cases = [(1, "a/x.PDF", None, "degraded", None), (2, "a/y.pdf", None, None, ""), (3, "a/z.webp", None, None, "photo"), (4, "gone.pdf", None, None, None), (5, None, "words", None, None), (6, "a/n.docx", None, None, None), (7, None, None, None, None)]
    files = spark.createDataFrame([(p,) for p in ("a/x.PDF", "a/y.pdf", "a/y.pdf", "a/z.webp", "a/n.docx")], "path string")
    got = experiments.runnable(spark.createDataFrame(cases, "id int, path string, text string, type string, input_kind string"), files)
    assert sorted((r.id, r.input_kind) for r in got.collect()) == [(1, "pdf_scanned"), (2, "pdf_native"), (3, "photo"), (5, None)]


def test_readers_are_chosen(spark):
    assert readings.selected_reader(" RapidOCR", {"easyocr", "rapidocr"}) == "rapidocr"
    assert readings.selected_reader("paddleocr", {"easyocr"}) == "easyocr" and readings.selected_reader("rapidocr", set()) == "rapidocr" and readings.selected_reader(None, set()) == "easyocr"
    rows = spark.createDataFrame([("a_native_pdf.pdf",), ("SCANNED_BLURRY_PDF_1.pdf",), ("x.png",), (None,)], "n string").select(readings.policy(F.col("n"), otherwise="rapidocr").alias("p"))
    assert [tuple(r.p) for r in rows.collect()] == [("native_pdf", "easyocr", "auto"), ("scanned_blurry_pdf", "paddleocr", "ocr_only"), ("image", "rapidocr", "auto"), ("unknown", "rapidocr", "auto")]


def test_answers_of_a_model(spark):
    def model(prompts, images=None):
        if any("bad" in p for p in prompts):
            raise KeyError("bad")
        return [p.upper() + ("" if images is None else str(sum(map(len, i)))) for p, i in zip(prompts, images or [None] * len(prompts), strict=True)]

    rows = spark.createDataFrame([(1, "a", [b"xy", b"z"]), (2, "bad", []), (3, None, None)], "id int, prompt string, images array<binary>").coalesce(1)
    got = {r.id: (r.answer, r.failed) for r in readings.answered(rows, model).collect()}
    assert got == {1: ("A", None), 2: (None, "KeyError"), 3: ("", None)}
    assert {r.id: r.answer for r in readings.answered(rows, model, images="images").collect()} == {1: "A3", 2: None, 3: "0"}


def test_readings_edges(spark):
    form = "page int, candidate int, text string, confidences array<double>"
    rows = [(1, 0, None, None), (2, 1, "uno dos tres", [0.5]), (2, 0, "uno dos tres", [0.5]), (3, 0, "?!?!?!", []), (None, 0, "casa", None)]
    got = {r.page: r.text for r in readings.best_reading(spark.createDataFrame(rows, form), ["page"]).collect()}
    assert got == {1: "", 2: "uno dos tres", 3: "", None: "casa"}
    images = spark.createDataFrame([(1, 0, b""), (2, 0, b"ab"), (2, 1, b"cd"), (2, 2, None), (None, 0, b"x")], "page int, position int, content binary")
    assert sorted((r.page or 0, r.position) for r in readings.largest_images(images, ["page"]).collect()) == [(0, 0), (2, 0)]
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "doc int, page int, ocr string")
    assert [r.page_text for r in readings.page_texts(pages).orderBy("page").collect()] == ["x", ""]


def test_document_texts_shuffles_texts_once(spark):
    docs = spark.createDataFrame([(1, 2), (1, None), (2, 3), (None, 4), (5, 1)], "doc int, n_pages int")
    read = spark.createDataFrame([(1, 2, "b ", True), (1, 1, " a", False), (2, 1, "", True), (None, 1, "x", False), (9, 1, "lost", False)], "doc int, page int, page_text string, fell_back boolean")
    got = readings.document_texts(docs, read, "doc", "easyocr")
    assert got.columns == ["doc", "text", "n_pages", "n_images", "method"] and got.schema["doc"].dataType.simpleString() == "int"
    both = "easyocr+vision"
    want = [(1, "a\n\nb", 2, 2, both), (1, "a\n\nb", None, 2, both), (2, "", 3, 1, "vision"), (None, "x", 4, 1, "easyocr"), (5, "", 1, 0, "vision")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    plan = got._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_small_helpers(spark):
    m = spark.createDataFrame([({"a": "", "b": "x"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in m.select(first_of(F.col("m"), "a", "b")).collect()] == ["x", "", ""]
    states = spark.createDataFrame([("OK",), ("REVISAR",), (None,)], "s string")
    assert stats.in_states(states, "s", ["OK"]).count() == 1 and stats.in_states(states, "s").count() == 3
    own = Schema("s", fields=(Field("a", "number", True), Field("b", constraints=(Constraint("enum", ["x", 1]),))))
    told = instructions(own).splitlines()
    assert told[8:] == ['- "a" (number) requerido=True', "- \"b\" (string) requerido=False valores_permitidos=['x', '1']", "Si no encuentras un valor, usa null."]
    assert len(instructions(INVOICE).splitlines()) == 9 + len(INVOICE.fields)
