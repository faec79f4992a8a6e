"""Readers of documents, ground truths, logs, results and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators.experiments import run_id, truth_key
from ledgerlens.plans.schema import Schema

DOCUMENT_GLOB = "*.{pdf,jpg,jpeg,png,PDF,JPG,JPEG,PNG}"
RECORD_TYPES = {"number": "double", "integer": "bigint", "boolean": "boolean"}
# The columns of an evaluation row, in order.
EVALUATION_ROW = (
    "run_seed BIGINT, reading_mode STRING, case_id STRING, pdf STRING, schema STRING, degraded_text BOOLEAN, text_method STRING, extractor_backend STRING, "
    "fields_total BIGINT, fields_gt_present BIGINT, fields_pred_present BIGINT, exact_matches BIGINT, match_rate DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, "
    "document_correct BOOLEAN, llm_returned_empty BOOLEAN, rules_total BIGINT, rules_gt_evaluable BIGINT, rules_pred_evaluable BIGINT, rules_matches BIGINT, "
    "rules_accuracy DOUBLE, rules_coverage DOUBLE, latency_s DOUBLE, ram_peak_mb DOUBLE, mismatch_count BIGINT"
)
LOG_ROW = (
    "timestamp STRING, file_name STRING, file_type STRING, method STRING, processing_time_seconds DOUBLE, ram_used_mb DOUBLE, extracted_fields MAP<STRING,STRING>, "
    "full_result STRUCT<schema: STRUCT<name: STRING, version: STRING>, document_type: STRING, extracted: MAP<STRING,STRING>, "
    "normalization: STRUCT<autocorrections: ARRAY<STRUCT<field: STRING, kind: STRING, before: STRING, after: STRING>>>, "
    "validation: STRUCT<valid: BOOLEAN, issues: ARRAY<STRUCT<level: STRING, field: STRING, code: STRING, message: STRING>>>, "
    "report: STRUCT<json: STRUCT<score_confianza: DOUBLE, decision_rules: ARRAY<STRUCT<id: STRING, severidad: STRING, cumple: BOOLEAN>>>>>"
)


def documents(spark: SparkSession, path: str, variants: list[str] | None = None) -> DataFrame:
    """(path, content, length, doc_id = SHA-256, name, key) of the document files below a folder, those in a variant's folder if any is named."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", DOCUMENT_GLOB).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", "content", "length", F.sha2("content", 256).alias("doc_id"), name.alias("name"), truth_key(F.col("path")).alias("key"))
    return rows.where(F.exists(F.split("path", "/"), lambda p: p.isin(*variants))) if variants else rows


def record_type(schema: Schema) -> str:
    return ", ".join(f"`{f.name}` {RECORD_TYPES.get(f.type, 'string')}" for f in schema.fields)


def truths(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Ground truths, one JSON file each, as typed records with path and key; what doesn't fit its type is null."""
    rows = spark.read.schema(record_type(schema)).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("path", F.input_file_name()).withColumn("key", truth_key(F.col("path")))


def paired(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents with their truth; unpaired ones of either side go."""
    return docs.join(truth.drop("path"), "key")


def execution_logs(spark: SparkSession, path: str, newest: int = 300) -> DataFrame:
    """The newest logs by file name, broken ones dropped, flattened; the limit comes before all else."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    files = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("log"), "value").orderBy(F.desc("log")).limit(newest)
    parsed = files.select("log", F.from_json("value", f"{LOG_ROW}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    fine = parsed.where(F.col("r._corrupt").isNull()).select("log", "r.*")
    result = F.col("full_result")
    filled = F.size(F.filter(F.map_values(F.coalesce("extracted_fields", F.create_map().cast("map<string,string>"))), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return fine.select(
        "log",
        "timestamp",
        "file_name",
        "file_type",
        "method",
        F.col("processing_time_seconds").alias("latency_s"),
        F.col("ram_used_mb").alias("ram_mb"),
        result["schema"]["name"].alias("schema"),
        result["document_type"].alias("document_type"),
        result["validation"]["valid"].alias("valid"),
        result["report"]["json"]["score_confianza"].alias("score"),
        filled.alias("fields_filled"),
        F.coalesce(F.size(result["validation"]["issues"]), F.lit(0)).alias("n_issues"),
        "extracted_fields",
        result["validation"]["issues"].alias("issues"),
        result["report"]["json"]["decision_rules"].alias("rules"),
    )


def log_issues(logs: DataFrame) -> DataFrame:
    return logs.select("log", "file_name", "schema", F.posexplode("issues").alias("position", "i")).select("log", "file_name", "schema", "position", "i.level", "i.field", "i.code", "i.message")


def log_fields(logs: DataFrame) -> DataFrame:
    """Extracted fields of logs in long form, keyed by the stem that documents share with their truths."""
    return logs.select(truth_key(F.col("file_name")).alias("key"), F.explode("extracted_fields").alias("field", "value")).withColumn("number", F.lit(None).cast("double"))


def evaluation_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """Evaluation CSVs with run number, seed and label of their file names."""
    parts = [spark.read.schema(EVALUATION_ROW).option("header", True).csv(p) for p in paths]
    rows = reduce(DataFrame.unionByName, parts).withColumn("file", F.input_file_name())
    run = run_id(F.col("file"))
    return rows.withColumns({"run_number": run["number"], "seed": F.coalesce(run["seed"], F.col("run_seed")), "config_label": run["label"]})


def newest_pair(files: DataFrame, stem: str, kinds: tuple[str, str] = ("csv", "json")) -> DataFrame:
    """Of listed files (path) with a stem the newest pair of both suffixes; without a pair the newest of each."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", F.regexp_extract(name, rf"\A{stem}(.*)\.(\w+)\z", 1).alias("tail"), F.regexp_extract(name, r"\.(\w+)\z", 1).alias("kind")).where(F.col("kind").isin(*kinds))
    both = rows.groupBy("tail").agg(F.count_distinct("kind").alias("n")).where("n = 2").select("tail", F.lit(True).alias("paired"))
    ranked = rows.join(both, "tail", "left").withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc_nulls_last("paired"), F.desc("tail"))))
    return ranked.where("r = 1").select("kind", "path")


def mismatches(spark: SparkSession, path: str) -> DataFrame:
    """(file, field) of mismatch files of either shape, a list or an object with field_mismatches."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    row = "array<struct<field:string>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", row)).otherwise(F.from_json("value", f"struct<field_mismatches:{row}>")["field_mismatches"])
    return raw.select("file", F.explode(listed).alias("m")).select("file", "m.field")


def manifest_cases(spark: SparkSession, path: str, case: str = "id string, name string, schema_name string, type string, input_kind string, variant string, compliance_expected boolean, file_path string, prepared_file_path string, pdf_path string, image_path string, status string") -> DataFrame:
    """A manifest's cases, each with the first of its paths that is named."""
    rows = spark.read.schema(f"country string, test_cases array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in case.split(','))}>>").option("multiLine", True).json(path)
    cases = rows.select("country", F.explode("test_cases").alias("c")).select("country", "c.*")
    return cases.withColumn("path", F.coalesce("prepared_file_path", "file_path", "pdf_path", "image_path"))


def fresh_cache(cache: DataFrame, now, minutes: int = 30) -> DataFrame:
    """Cached texts (doc_id, text, cached_at) that are not too old at ``now``."""
    return cache.where(F.col("cached_at") > now - F.make_interval(mins=F.lit(minutes)))
