"""Experiment grids, case lifecycles and what is derived from file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Variants in the order in which a file name is searched, and configurations of the ablation.
VARIANTS = ("native_pdf", "scanned_blurry_pdf", "image_photo", "image_handwritten")
FAMILIES = (("IRPF", ("irpf",)), ("FACTURA", ("factura",)), ("EXTRACTO", ("extracto",)), ("CONTRATO", ("contrato", "hipoteca")))
SUFFIXES = {"pdf": "pdf", "jpg": "image", "jpeg": "image", "png": "image"}
READY = ("copied", "generated", "ready", "prepared")


def grid(schemas: DataFrame, variants: DataFrame, cases: DataFrame) -> DataFrame:
    """Every schema, variant and case with its id and its place in the order of the three: design dimensions, a few rows each."""
    rows = schemas.crossJoin(variants).crossJoin(cases)
    name = F.concat_ws("-", "schema_name", "variant", "case_name")
    w = Window.orderBy("schema_name", "variant", "case_name")
    return rows.withColumns({"case_id": name, "sequence": F.row_number().over(w).cast("long")})


def run_grid(configs: DataFrame, seeds: DataFrame, done: DataFrame | None = None, rows: int = 120) -> DataFrame:
    """Runs (config, seed) of an ablation; those of ``done`` (config, seed, n) with all their rows are left out."""
    every = configs.crossJoin(seeds)
    return every if done is None else every.join(done.where(F.col("n") >= rows), ["config", "seed"], "left_anti")


def variant_of(name: Column, kind: Column | None = None) -> Column:
    n = F.lower(name)
    out = reduce(lambda w, v: w.when(F.contains(n, F.lit(v)), v), VARIANTS[1:], F.when(F.contains(n, F.lit(VARIANTS[0])), VARIANTS[0]))
    return out if kind is None else F.coalesce(out, kind)


def family_of(name: Column) -> Column:
    n = F.lower(name)
    tests = [F.when(reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in words]), F.lit(family)) for family, words in FAMILIES]
    return F.coalesce(*tests, F.lit("OTRO"))


def input_kind(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))
    return reduce(lambda w, s: w.when(suffix == s, SUFFIXES[s]), list(SUFFIXES)[1:], F.when(suffix == "pdf", "pdf")).otherwise("unknown")


def file_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(F.contains(n, F.lit("scanned")), "scanned_pdf").when(input_kind(name) == "image", "image").otherwise("native_pdf")


def run_id(path: Column) -> Column:
    """struct<number, seed, label> of NN_seedSSSS_LABEL.csv."""
    p = r"(\d+)_seed(\d+)_([^/]+?)(?:\.[A-Za-z]+)?\z"
    return F.struct(*[F.nullif(F.regexp_extract(path, p, i), F.lit("")).try_cast(k).alias(n) for i, (n, k) in enumerate((("number", "bigint"), ("seed", "bigint"), ("label", "string")), 1)])


def truth_key(name: Column) -> Column:
    """The stem that a document and its ground truth share."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*\z", "")
    return F.regexp_replace(F.lower(stem), r"(_?ground_truth_?|_gt)", "")


def with_truth(docs: DataFrame, truths: list[DataFrame], key: str = "key") -> DataFrame:
    """Documents with the truth of the first root that has one (each: key, truth); others go."""
    roots = reduce(DataFrame.unionByName, [r.select(key, "truth").withColumn("_root", F.lit(i)) for i, r in enumerate(truths)])
    w = Window.partitionBy(key).orderBy("_root", "truth")
    best = roots.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_root")
    return docs.join(best, key)


def advance(cases: DataFrame, event: str, done: Column) -> DataFrame:
    """The next state of each case: ``copy``, ``generate`` and ``prepare`` succeed where ``done``; ready cases stay."""
    to = {"copy": "copied", "generate": "generated", "prepare": "prepared", "ready": "ready"}[event]
    new = F.when(F.col("status") == "ready", "ready").when(done, to).otherwise("failed" if event == "generate" else F.coalesce("status", F.lit("pending")))
    return cases.withColumn("status", new)


def mark_ready(cases: DataFrame, case_id: str) -> DataFrame:
    """The cases with one of them ready; an unknown id fails the query."""
    found = cases.agg(F.assert_true(F.count_if(F.col("case_id") == case_id) > 0, F.lit(f"no case {case_id}")).alias("fine"))
    return cases.join(F.broadcast(found.where("fine is null"))).drop("fine").withColumn("status", F.when(F.col("case_id") == case_id, "ready").otherwise(F.col("status")))


def ready_candidates(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases that are not ready and of which both files are listed (files: path)."""
    open_ = cases.where(~F.coalesce(F.col("status") == "ready", F.lit(False)))
    have = files.select("path").distinct()
    one = open_.join(have, open_["file_path"] == have["path"], "left_semi")
    return one.join(have, one["truth_path"] == have["path"], "left_semi")


def status_counts(cases: DataFrame, by: str = "schema_name") -> DataFrame:
    """Cases, ready-like and pending ones, by schema."""
    own = F.coalesce(F.col("status").isin(*READY), F.lit(False))
    return cases.groupBy(by).agg(F.count("*").alias("n"), F.count_if(own).alias("n_ready"), F.count_if(~own).alias("n_pending"))


def review_queue(cases: DataFrame, schema: str | None = None, variant: str | None = None, limit: int = 0) -> DataFrame:
    """Cases to review that are not meant to comply, by schema, variant priority and id."""
    from ledgerlens.operators.stats import priority

    rows = cases.where(~F.col("compliance_expected"))
    rows = rows.where(F.col("schema_name") == schema) if schema else rows
    rows = rows.where(F.col("variant") == variant) if variant else rows
    rows = rows.withColumn("priority", priority(F.col("variant"), list(VARIANTS))).orderBy("schema_name", "priority", "case_id")
    return rows.limit(limit) if limit else rows


# Of each schema its name, the norms it follows and how a case is made to break them; what is noted of variants that are not made yet.
CASE_TEXTS = {
    "credito_hipotecario": {
        "label": "Hipotecario",
        "norms": ("Espana - RGPD art. 5", "Espana - RGPD art. 25", "Espana - RGPD art. 22", "Espana - Ley 5/2019 LCCI", "Espana - Circular 4/2017 Banco de Espana"),
        "breaks": ("Eliminar identificador documental o FEIN/FIAE", "Introducir TAE incoherente o plazo imposible", "Introducir ratio de endeudamiento superior al umbral"),
    },
    "auditoria_fiscal": {
        "label": "Auditoria fiscal",
        "norms": ("Espana - RGPD art. 5", "Espana - RGPD art. 25", "Espana - Real Decreto 1619/2012", "Espana - Ley 37/1992 del IVA"),
        "breaks": ("Modificar tipo de IVA a un valor no permitido", "Descuadrar cuota IVA o importe total", "Eliminar numero de factura o fecha obligatoria"),
    },
    "kyc_onboarding": {
        "label": "KYC / onboarding",
        "norms": ("Espana - RGPD art. 5", "Espana - RGPD art. 25", "Espana - RGPD art. 22", "Espana - Ley 10/2010 PBC/FT", "Espana - RD 304/2014"),
        "breaks": ("Documento caducado o numero no legible", "Marcar coincidencia positiva en sanciones", "Asignar PEP con nivel de riesgo bajo o sin titular real"),
    },
}
NOTES = {
    "scanned_blurry_pdf": (
        "Imprimir o rasterizar el documento y volver a escanearlo.",
        "Aplicar desenfoque, compresion JPEG, ruido o bajo contraste.",
        "Mantener correspondencia con el ground truth si el documento sigue siendo conforme.",
    ),
    "image_photo": ("Capturar foto movil con perspectiva realista.", "Incluir variaciones de iluminacion y fondo moderado."),
    "image_handwritten": ("Anadir notas a mano alzada, marcas o texto manuscrito sobre el documento.", "Puede ser documento fotografiado o escaneado como imagen."),
    "native_pdf": ("Crear una version digital que incumpla reglas o parametros conservando estructura nativa.",),
}
CASE_ROOT = "test_data/experimentos_120"


def _texts_by(column: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The texts of a key; none for all else."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*entries)[column], F.array().cast("array<string>"))


def pending_path(schema: Column, variant: Column, stem: Column, compliance: Column, extension: Column, root: str = CASE_ROOT) -> Column:
    """Where the file of a case will lie that is not made yet."""
    return F.concat(F.lit(f"{root}/"), schema, F.lit("/"), variant, F.lit("/"), compliance, F.lit("/"), stem, F.lit("_"), variant, F.lit("_"), compliance, extension)


def case_entries(cases: DataFrame, country: str = "Espana") -> DataFrame:
    """A manifest's rows of cases (schema_name, case_index, variant, extension, compliance, source_pdf_path, ready).

    A case that complies and is ready keeps its truth (kept_truth); one that doesn't comply says how it is to break its rules;
    one that is not ready names its future path and says how it is made. Null ``ready`` counts as not ready.
    """
    c = {n: F.col(n) for n in ("schema_name", "variant", "compliance", "extension", "source_pdf_path")}
    number = F.format_string("%03d", "case_index")
    label = F.create_map(*[F.lit(x) for k, v in CASE_TEXTS.items() for x in (k, v["label"])])[c["schema_name"]]
    stem = F.regexp_replace(F.element_at(F.split(c["source_pdf_path"], "/"), -1), r"\.[^.]*\z", "")
    good, ready = c["compliance"] == "conforme", F.coalesce(F.col("ready"), F.lit(False))
    none = F.array().cast("array<string>")
    return cases.select(
        F.concat_ws("_", c["schema_name"], c["variant"], c["compliance"], number).alias("id"),
        F.concat_ws(" - ", label, c["variant"], c["compliance"], number).alias("name"),
        F.lit(country).alias("country"),
        "schema_name",
        "variant",
        c["compliance"].alias("compliance_expected"),
        _texts_by(c["schema_name"], {k: v["norms"] for k, v in CASE_TEXTS.items()}).alias("legal_basis"),
        F.when(ready, c["source_pdf_path"]).otherwise(pending_path(c["schema_name"], c["variant"], stem, c["compliance"], c["extension"])).alias("file_path"),
        "source_pdf_path",
        good.alias("kept_truth"),
        F.when(good & ready, "ready").otherwise("pending_adjustment").alias("ground_truth_status"),
        F.when(ready, "ready").otherwise("pending_generation").alias("acquisition_status"),
        F.when(good, none).otherwise(_texts_by(c["schema_name"], {k: v["breaks"] for k, v in CASE_TEXTS.items()})).alias("rule_break_plan"),
        F.when(ready, none).otherwise(_texts_by(c["variant"], NOTES)).alias("generation_notes"),
    )


def runnable(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Cases (path, text, type, input_kind) that can be run: those with a text, and those of which the file is listed (files: path) and can be read.

    input_kind, where it isn't given, is told from the end of the path: a PDF is scanned if its type is degraded.
    """
    end = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"(\.[^./]+)\z", 1))
    kind = F.when(end == ".pdf", F.when(F.col("type") == "degraded", "pdf_scanned").otherwise("pdf_native")).when(end.isin(".png", ".jpg", ".jpeg", ".webp"), "image")
    listed = files.select(F.col("path").alias("_path")).distinct().withColumn("_listed", F.lit(True))
    j = cases.join(listed, F.col("path") == F.col("_path"), "left")
    own = F.col("text").isNotNull()
    j = j.where(own | (F.col("_listed") & kind.isNotNull())).withColumn("input_kind", F.when(own, F.col("input_kind")).otherwise(F.coalesce(F.nullif("input_kind", F.lit("")), kind)))
    return j.drop("_path", "_listed")


# Contracts whose truth has a name of its own: start, folder and start of the truth's name.
NAMED_TRUTHS = ("contrato_hipoteca_esp_", "caso_uso_1_auditoria_hipotecaria", "ground_truth_esp_")


def truth_names(file_name: Column) -> Column:
    """array<string>: the names of truths to look for, in order; of a contract the one of its number comes first, with its folder."""
    stem = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"(?<=.)\.[^.]*\z", "")
    start, folder, other = NAMED_TRUTHS
    special = F.when(stem.startswith(start), F.concat(F.lit(f"{folder}/{other}"), F.substring_index(stem, "_", -1), F.lit(".json")))
    return F.array_compact(F.array(special, F.concat(stem, F.lit(".json")), F.concat(stem, F.lit("_ground_truth.json"))))


def found_truths(logs: DataFrame, truths: DataFrame, key: str = "log", roots: int = 3) -> DataFrame:
    """(key, truth_path) of the truth of each log (key, file_name); logs without one go.

    truths: path and root, the place of its root in the order of search, from 0. A name is looked for in all roots before
    the next one; of several hits in a root the first path counts. A name with a folder is looked for in the first root alone.
    """
    wanted = logs.where(F.trim("file_name") != "").select(F.col(key).alias("_key"), F.posexplode(truth_names(F.col("file_name"))).alias("_at", "_name"))
    part = lambda i: F.element_at(F.split("path", "/"), i)
    listed = truths.where(F.col("root") < roots).select("path", "root", part(-1).alias("_name"))
    nested = truths.where(F.col("root") == 0).select("path", "root", F.concat(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("/"), part(-1)).alias("_name"))
    hits = wanted.join(listed.unionByName(nested), "_name")
    return hits.groupBy(F.col("_key").alias(key)).agg(F.min(F.struct("_at", "root", "path")).alias("_best")).select(key, F.col("_best.path").alias("truth_path"))
