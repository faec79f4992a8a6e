"""Quality of extracted fields and rules against a truth.

The five field metrics differ in what they call equal and what they count, and stay apart. Fields
stand in long form: keys, field, value (text), and number where a value is one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import f1_of, strict_number
from ledgerlens.functions.text import is_empty, values_equal
from ledgerlens.operators.stats import p95_rows

TOLERANCE = 0.01


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def compare_by_truth(predicted: DataFrame, truth: DataFrame, keys: list[str], tolerance: float = TOLERANCE, numeric_texts: bool = False) -> DataFrame:
    """keys, field, pred, gt, pred_has, gt_has, equal, kind of each field of the truth (the truth drives).

    equal: numbers within the tolerance, else texts by their compared form; null is not ''. kind: miss,
    spurious, value or other where unequal. numeric_texts: texts that read as numbers count as such.
    """
    p = predicted.select(*keys, "field", F.col("value").alias("pred"), F.col("number").alias("pred_number"))
    t = truth.select(*keys, "field", F.col("value").alias("gt"), F.col("number").alias("gt_number"))
    j = t.join(p, [*keys, "field"], "left")
    a, b = F.col("pred_number"), F.col("gt_number")
    if numeric_texts:
        a, b = F.coalesce(a, strict_number(F.col("pred"))), F.coalesce(b, strict_number(F.col("gt")))
    j = j.withColumns({"pred_has": ~is_empty(F.col("pred")), "gt_has": ~is_empty(F.col("gt")), "equal": values_equal(F.col("pred"), F.col("gt"), a, b, tolerance)})
    kind = F.when(F.col("gt_has") & ~F.col("pred_has"), "miss").when(~F.col("gt_has") & F.col("pred_has"), "spurious").when(F.col("gt_has") & F.col("pred_has"), "value").otherwise("other")
    return j.withColumn("kind", F.when(~F.col("equal"), kind)).drop("pred_number", "gt_number")


def field_metrics(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: counts, precision, recall, f1, match rate, document_correct, sorted mismatches."""
    a = compared.groupBy(*keys).agg(
        F.count("*").alias("fields_total"),
        F.count_if("gt_has").alias("fields_gt_present"),
        F.count_if("pred_has").alias("fields_pred_present"),
        F.count_if(F.col("equal") & F.col("gt_has")).alias("exact_matches"),
        F.bool_and("equal").alias("document_correct"),
        F.count_if(~F.col("equal")).alias("mismatch_count"),
        F.array_sort(F.collect_list(F.when(~F.col("equal"), F.struct("field", "pred", "gt", "kind")))).alias("mismatches"),
    )
    a = a.withColumns({"precision": _ratio(F.col("exact_matches"), F.col("fields_pred_present")), "recall": _ratio(F.col("exact_matches"), F.col("fields_gt_present")), "match_rate": _ratio(F.col("exact_matches"), F.col("fields_gt_present"))})
    return a.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def strict_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per document tp, fp, fn by strict equality (null equals null); extra keys are fp, missing ones fn, unequal ones both."""
    p = predicted.select(*keys, "field", F.col("value").alias("pred"), F.lit(True).alias("in_pred"))
    t = truth.select(*keys, "field", F.col("value").alias("gt"), F.lit(True).alias("in_gt"))
    j = p.join(t, [*keys, "field"], "full_outer")
    both = F.col("in_pred").isNotNull() & F.col("in_gt").isNotNull()
    same = both & F.col("pred").eqNullSafe(F.col("gt"))
    a = j.groupBy(*keys).agg(
        F.count_if(same).alias("tp"),
        F.count_if(F.col("in_pred").isNotNull() & ~same).alias("fp"),
        F.count_if(F.col("in_gt").isNotNull() & ~same).alias("fn"),
        F.coalesce(F.bool_and(F.when(both, same)), F.lit(True)).alias("exact"),
    )
    return a.withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))


def filled_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str], skip: tuple[str, ...] = ("id_documento",)) -> DataFrame:
    """By the truth's fields but the skipped ones; equal and both filled is a hit."""
    c = compare_by_truth(predicted, truth.where(~F.col("field").isin(*skip)), keys, numeric_texts=True)
    hit = F.col("equal") & F.col("gt_has") & F.col("pred_has")
    a = c.groupBy(*keys).agg(F.count("*").alias("fields_total"), F.count_if(hit).alias("hits"), F.count_if("pred_has").alias("fields_pred"), F.count_if("gt_has").alias("fields_gt"))
    a = a.withColumns({"precision": _ratio(F.col("hits"), F.col("fields_pred")), "recall": _ratio(F.col("hits"), F.col("fields_gt"))})
    return a.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def union_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Over the union of keys by trimmed lower-cased texts; a wrong value is fp alone, fn only where none was predicted."""
    form = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    j = predicted.select(*keys, "field", F.col("value").alias("p")).join(truth.select(*keys, "field", F.col("value").alias("t")), [*keys, "field"], "full_outer")
    j = j.withColumns({"p": form("p"), "t": form("t")})
    hit = (F.col("p") == F.col("t")) & (F.col("p") != "")
    a = j.groupBy(*keys).agg(F.count_if(hit).alias("tp"), F.count_if((F.col("p") != "") & ~hit).alias("fp"), F.count_if((F.col("p") == "") & (F.col("t") != "")).alias("fn"))
    return a.withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))


def rule_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Per document over the union of rule ids: evaluable counts, matches, accuracy (of those evaluable in the prediction), coverage."""
    j = predicted.select(*keys, "rule_id", F.col("holds").alias("p")).join(truth.select(*keys, "rule_id", F.col("holds").alias("t")), [*keys, "rule_id"], "full_outer")
    a = j.groupBy(*keys).agg(
        F.count("*").alias("rules_total"),
        F.count_if(F.col("t").isNotNull()).alias("rules_gt_evaluable"),
        F.count_if(F.col("p").isNotNull()).alias("rules_pred_evaluable"),
        F.count_if(F.col("p") == F.col("t")).alias("rules_matches"),
    )
    return a.withColumns({"rules_accuracy": _ratio(F.col("rules_matches"), F.col("rules_pred_evaluable")), "rules_coverage": _ratio(F.col("rules_pred_evaluable"), F.col("rules_total"))})


def micro(matches: Column, predicted: Column, truth: Column, prefix: str = "micro_") -> list[Column]:
    """Precision, recall and F1 as ratios of sums."""
    p, r = _ratio(F.sum(matches), F.sum(predicted)), _ratio(F.sum(matches), F.sum(truth))
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), _f1(p, r).alias(f"{prefix}f1")]


def micro_rules(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sums of the rule counts of documents, and accuracy and coverage as ratios of the sums."""
    counts = ("rules_total", "rules_gt_evaluable", "rules_pred_evaluable", "rules_matches")
    a = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return a.withColumns({"micro_rules_accuracy": _ratio(F.col("rules_matches"), F.col("rules_pred_evaluable")), "micro_rules_coverage": _ratio(F.col("rules_pred_evaluable"), F.col("rules_total"))})


def recalculated(rows: DataFrame, by: list[str], seed: str = "seed", seeds: int = 3) -> DataFrame:
    """Micro figures of summed tp, fp and fn, and the share of exact documents as the mean over seeds by unique documents.

    rows has tp, fp, fn, document_correct and rules_accuracy; a group whose rows are no multiple of ``seeds`` fails the query.
    """
    tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    a = rows.groupBy(*by).agg(F.count("*").alias("rows"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if("document_correct").alias("_right"), F.avg("rules_accuracy").alias("rules_accuracy"))
    whole = F.assert_true(F.col("rows") % seeds == 0, F.lit(f"rows are no multiple of {seeds}"))
    a = a.where(whole.isNull()).withColumns({"unique_documents": (F.col("rows") / seeds).cast("long"), "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")), "perfect_mean": F.col("_right") / seeds})
    return a.withColumns({"f1": _f1(F.col("precision"), F.col("recall")), "emr_pct": F.col("perfect_mean") / F.col("unique_documents") * 100.0}).drop("_right")


SUMMARY = [
    lambda: F.count("*").alias("runs"),
    lambda: F.avg("f1").alias("macro_f1"),
    lambda: F.avg("match_rate").alias("macro_match_rate"),
    lambda: F.avg("latency_s").alias("avg_latency_s"),
    lambda: F.avg("ram_peak_mb").alias("avg_ram_peak_mb"),
    lambda: F.count_if("document_correct").alias("documents_correct"),
    lambda: _ratio(F.count_if("document_correct"), F.count("*")).alias("exact_match_rate"),
]


def summarize(rows: DataFrame, by: list[str], more: Iterable[Column] = ()) -> DataFrame:
    """Macro and micro figures over all rows and by each column alone, in one pass, and the 95th percentile of the latency in another.

    grouping is `overall` or the column's name; key its value as text, null for overall. more: further aggregates.
    """
    cols = [F.col(b).cast("string").alias(b) for b in by]
    base = rows.select(*[c for c in rows.columns if c not in by], *cols)
    sets = [[], *[[F.col(b)] for b in by]]
    out = base.groupingSets(sets, *[F.col(b) for b in by]).agg(
        *[make() for make in SUMMARY], *more, *micro(F.col("exact_matches"), F.col("fields_pred_present"), F.col("fields_gt_present")), F.grouping_id(*by).alias("gid")
    )
    every = (1 << len(by)) - 1
    name = F.when(F.col("gid") == every, "overall")
    key = F.lit(None).cast("string")
    for i, b in enumerate(by):
        own = every ^ (1 << (len(by) - 1 - i))
        name = name.when(F.col("gid") == own, b)
        key = F.when(F.col("gid") == own, F.col(b)).otherwise(key)
    out = out.withColumns({"grouping": name, "key": key}).drop("gid", *by)
    places = [F.struct(F.lit("overall").alias("_g"), F.lit(None).cast("string").alias("_k")), *[F.struct(F.lit(b).alias("_g"), F.col(b).alias("_k")) for b in by]]
    late = p95_rows(base.select("latency_s", F.inline(F.array(*places))), ["_g", "_k"], "latency_s").select("_g", "_k", F.col("p95").alias("p95_latency_s"))
    own = (out["grouping"] == late["_g"]) & out["key"].eqNullSafe(late["_k"])
    return out.join(late, own, "left").drop("_g", "_k").withColumn("p95_latency_s", F.coalesce("p95_latency_s", F.lit(0.0)))


def with_all_keys(summary: DataFrame, grouping: str, keys: list[str]) -> DataFrame:
    """Adds rows of zeros for keys of a grouping that have none."""
    want = summary.sparkSession.createDataFrame([(grouping, k) for k in keys], "grouping string, key string")
    return summary.unionByName(want.join(summary, ["grouping", "key"], "left_anti"), allowMissingColumns=True).na.fill(0)


def error_counts(compared: DataFrame) -> DataFrame:
    """Errors, checks and error rate of each field that has an error."""
    a = compared.groupBy("field").agg(F.count_if(~F.col("equal")).alias("errors"), F.count("*").alias("checked"))
    return a.where("errors > 0").withColumn("error_rate", F.col("errors") / F.col("checked"))


def top_errors(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n fields with most errors, ties by name."""
    return counts.orderBy(F.desc("errors"), "field").limit(n)


def rule_outcomes(reports: DataFrame, keys: list[str], report: str = "report") -> DataFrame:
    """(keys, rule_id, holds) of reports as JSON: their list decision_rules, or the one inside ``json`` if that is an object.

    A rule is named by its id, else its expression, else its description, else itself; what it says is null unless a boolean.
    Of rules of one name in a report the last counts; what is no object is left out.
    """
    v = F.try_parse_json(F.col(report))
    inner, outer = (F.try_variant_get(v, p, "array<variant>") for p in ("$.json.decision_rules", "$.decision_rules"))
    nested = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.json", "variant")).startswith("OBJECT"), F.lit(False))
    each = reports.select(*keys, F.posexplode(F.when(nested, inner).otherwise(outer)).alias("_at", "_r")).where(F.schema_of_variant("_r").startswith("OBJECT"))
    said = lambda name: F.nullif(F.trim(F.try_variant_get("_r", f"$.{name}", "string")), F.lit(""))
    holds = F.when(F.schema_of_variant(F.try_variant_get("_r", "$.cumple", "variant")) == "BOOLEAN", F.try_variant_get("_r", "$.cumple", "boolean"))
    named = each.select(*keys, "_at", F.coalesce(said("id"), said("expresion"), said("descripcion"), F.to_json("_r")).alias("rule_id"), holds.alias("holds"))
    return named.groupBy(*keys, "rule_id").agg(F.max_by("holds", "_at").alias("holds"))


def native_against_degraded(rows: DataFrame, kind: str = "file_type", native: str = "native_pdf") -> DataFrame:
    """F1, exact matches, latency and memory of native and other rows and their differences, in one row."""
    test = F.col(kind).eqNullSafe(F.lit(native))
    of = lambda c, n: F.when(test if n else ~test, F.col(c))
    a = rows.agg(*[f(of(c, n)).alias(f"{p}_{name}") for n, p in ((True, "native"), (False, "degraded")) for f, c, name in ((F.avg, "f1", "f1"), (F.avg, "latency_s", "latency_s"), (F.max, "ram_peak_mb", "ram_mb"))])
    return a.withColumns({f"delta_{n}": F.col(f"native_{n}") - F.col(f"degraded_{n}") for n in ("f1", "latency_s", "ram_mb")})


def targets_met(figures: DataFrame, targets: dict[str, tuple[str, float]]) -> DataFrame:
    """metric, value, goal, met of one row of figures; targets: column -> ('>=' or '<=', goal)."""
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(float(g)).alias("goal"), (F.col(n) >= g if op == ">=" else F.col(n) <= g).alias("met")) for n, (op, g) in targets.items()]
    return figures.select(F.inline(F.array(*rows)))


def backend_figures() -> list[Column]:
    """Figures of who read a group's documents and how their rules fared, to be asked of summarize by ``more``."""
    by = F.col("extractor_backend")
    rate = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0)).alias(f"avg_{c}")
    return [F.count_if(by == "llm").alias("runs_llm"), F.count_if(by == "heuristic").alias("runs_heuristic"), F.count_if("llm_returned_empty").alias("llm_returned_empty_count"), rate("rules_accuracy"), rate("rules_coverage")]


def evaluation_groups(rows: DataFrame, key: str, unknown: str = "desconocido") -> DataFrame:
    """Documents, exact ones and their share, mean F1 and match rate, and sums of fields, by key; null and empty keys are ``unknown``."""
    name = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(unknown))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(name.alias(key)).agg(
        F.count("*").alias("n"),
        F.count_if("exact_match").alias("n_exact"),
        F.round(F.count_if("exact_match") / F.count("*"), 4).alias("exact_match_rate"),
        F.round(F.avg("f1"), 4).alias("avg_f1"),
        F.round(F.avg("match_rate"), 4).alias("avg_match_rate"),
        total("fields_total").alias("fields_total"),
        total("fields_matched").alias("fields_matched"),
    )


def reader_matrix(rows: DataFrame, kind: str = "doc_type", reader: str = "ocr_backend") -> DataFrame:
    """Runs, micro figures of fields and rules, latency and exact documents of each kind of document under each reader."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(kind, reader).agg(
        F.count("*").alias("runs"),
        *micro(F.col("exact_matches"), F.col("fields_pred_present"), F.col("fields_gt_present")),
        _ratio(s("rules_matches"), s("rules_pred_evaluable")).alias("micro_rules_accuracy"),
        _ratio(s("rules_pred_evaluable"), s("rules_total")).alias("micro_rules_coverage"),
        F.avg("latency_s").alias("avg_latency_s"),
        (F.count_if("document_correct") / F.count("*")).alias("document_exact_match"),
    )
