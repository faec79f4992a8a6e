"""Rules, score, status and report of validated records."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_empty
from ledgerlens.operators.normalize import RAW, normalize
from ledgerlens.operators.validate import validate
from ledgerlens.plans.rules import Value, compile_rule, field_value, with_today
from ledgerlens.plans.schema import DecisionRule, Schema

NOT_EVALUABLE = "No se pudo evaluar la expresión."


def record_context(schema: Schema, columns: list[str], as_of: datetime.date | None = None) -> dict[str, Value]:
    """The rule context of normalized records."""
    out = {}
    for f in schema.fields:
        if f.name in columns:
            raw = F.col(RAW + f.name) if RAW + f.name in columns else None
            out[f.name] = field_value(F.col(f.name), f.type, raw)
        else:
            out[f.name] = Value()
    return with_today(out, as_of)


def outcome(rule: DecisionRule, context: dict[str, Value]) -> Column:
    """struct<id, description, expression, severity, holds, error>; holds is null where the rule can't be evaluated."""
    holds = compile_rule(rule.expression, context)
    return F.struct(
        F.lit(rule.id).alias("id"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.expression).alias("expression"),
        F.lit(rule.severity).alias("severity"),
        holds.alias("holds"),
        F.when(holds.isNull(), NOT_EVALUABLE).alias("error"),
    )


def apply_rules(records: DataFrame, rules, context: dict[str, Value]) -> DataFrame:
    """Adds rules array<struct<id, description, expression, severity, holds, error>>."""
    kind = "array<struct<id:string,description:string,expression:string,severity:string,holds:boolean,error:string>>"
    return records.withColumn("rules", F.array(*[outcome(r, context) for r in rules]).cast(kind) if rules else F.array().cast(kind))


def score_of(completeness: Column, valid: Column, confidence: Column) -> Column:
    """0.6 completeness + 0.4 valid, or 0.4, 0.3 and 0.3 confidence where there is one; within 0 and 1."""
    ok = valid.cast("double")
    plain = completeness * 0.6 + ok * 0.4
    known = completeness * 0.4 + ok * 0.3 + confidence * 0.3
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(confidence.isNull(), plain).otherwise(known)))


def fields_of_present(schema: Schema, present: Column) -> Column:
    """array<string>: the fields that a case with documents of these types is held to: theirs and those of no type, or all if that leaves none."""
    every = F.array(*[F.lit(f.name) for f in schema.fields])
    parts = [F.when(F.array_contains(present, f.document_type) if f.document_type else F.lit(True), F.lit(f.name)) for f in schema.fields]
    own = F.array_compact(F.array(*parts))
    return F.when(F.coalesce(F.size(present) > 0, F.lit(False)) & (F.size(own) > 0), own).otherwise(every)


def completeness_of(schema: Schema, columns: list[str], extra: list[str] = (), held_to: str | None = None) -> Column:
    filled = F.lit(0)
    if held_to:
        for name in (f.name for f in schema.fields if f.name in columns):
            c = F.col(name).cast("string")
            there = ~is_empty(F.coalesce(c, F.col(RAW + name)) if RAW + name in columns else c)
            filled = filled + (there & F.array_contains(held_to, name)).cast("int")
        return filled / F.greatest(F.size(held_to), F.lit(1))
    for name in [*(f.name for f in schema.fields if f.name in columns), *extra]:
        c = F.col(name).cast("string")
        filled = filled + (~is_empty(F.coalesce(c, F.col(RAW + name)) if RAW + name in columns else c)).cast("int")
    return filled / F.lit(max(1, len(schema.fields)))


def mean_confidence(details: Column) -> Column:
    """Mean of the confidences of a map<string, struct<..., confidence double, ...>>; null if there is none."""
    known = F.filter(F.transform(F.map_values(details), lambda d: d["confidence"]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def status_of(valid: Column, rules: Column) -> Column:
    """APROBADO if the record is valid and all critical rules hold, else REVISAR."""
    failed = F.exists(rules, lambda r: (r["severity"] == "critica") & ~F.coalesce(r["holds"], F.lit(False)))
    return F.when(valid & ~failed, "APROBADO").otherwise("REVISAR")


def document_state(valid: Column, issues: Column, rules: Column) -> Column:
    """CRITICO if a critical rule fails, REVISAR if there are issues, OK if valid, else REVISAR."""
    broken = F.exists(rules, lambda r: (r["severity"] == "critica") & (r["holds"] == F.lit(False)))
    return F.when(F.coalesce(broken, F.lit(False)), "CRITICO").when(F.size(issues) > 0, "REVISAR").when(valid, "OK").otherwise("REVISAR")


# What is said of each state.
STATE_TEXTS = {"OK": "OK - Valido", "CRITICO": "CRITICO - Regla critica", "REVISAR": "REVISAR - Revision manual"}


def summary_rows(audited: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, state_text, reason, n_issues, rules_ok, rules_total and what there is of valid and score, of audited records."""
    n = F.size("issues")
    reason = F.when(F.col("state") == "CRITICO", "Fallo de regla critica").when(n > 0, F.concat(n.cast("string"), F.lit(" incidencia(s)")))
    reason = reason.when(F.coalesce("valid", F.lit(False)), "Validacion correcta").otherwise("Pendiente de revision")
    said = F.create_map(*[F.lit(x) for pair in STATE_TEXTS.items() for x in pair])
    kept = F.filter("rules", lambda r: F.coalesce(r["holds"], F.lit(False)))
    return audited.select(*keys, "state", said[F.col("state")].alias("state_text"), reason.alias("reason"), "valid", n.cast("long").alias("n_issues"), "score", F.size(kept).cast("long").alias("rules_ok"), F.size("rules").cast("long").alias("rules_total"))


def markdown(schema: Schema) -> Column:
    """The readable report; its wording is fixed."""
    issue = F.transform("issues", lambda i: F.concat(F.lit("- ["), i["level"], F.lit("] "), i["field"], F.lit(": "), i["message"]))
    said = lambda r: F.when(r["holds"], "OK").when(~r["holds"], "NO CUMPLE").otherwise("NO EVALUABLE")
    rule = F.transform("rules", lambda r: F.concat(F.lit("- "), F.when(F.length(r["id"]) > 0, F.concat(r["id"], F.lit(" — "))).otherwise(""), r["description"], F.lit(": "), said(r)))
    lines = F.concat(
        F.array(F.lit(f"# Informe de auditoría — {schema.name}"), F.lit(""), F.concat(F.lit("- Estado: "), F.col("status")), F.concat(F.lit("- Válido (validación de campos): "), F.initcap(F.col("valid").cast("string"))), F.concat(F.lit("- Score confianza (0-1): "), F.format_string("%.2f", "score")), F.lit(""), F.lit("## Incidencias")),
        F.when(F.size("issues") > 0, issue).otherwise(F.array(F.lit("- Sin incidencias."))),
        F.array(F.lit(""), F.lit("## Reglas de decisión")),
        F.when(F.size("rules") > 0, rule).otherwise(F.array(F.lit("- No hay reglas definidas."))),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def audit(records: DataFrame, schema: Schema, *, as_of: datetime.date | None = None, details: str | None = None, present: str | None = None) -> DataFrame:
    """Normalizes, validates and audits raw records.

    Adds changes, autocorrections, issues, valid, rules, score, status, state and report. details: a
    column map<string, struct<..., confidence double, ...>>, for the score. Fields of the schema
    that are no columns count as null. as_of stands for today, so that runs repeat. present: a column array<string>,
    the document types of the record; fields of other types aren't asked for.
    """
    out = validate(normalize(records, schema), schema)
    if present:
        out = out.withColumn("_held_to", fields_of_present(schema, F.col(present)))
        out = out.withColumn("issues", F.filter("issues", lambda i: F.array_contains("_held_to", i["field"])))
        out = out.withColumn("valid", ~F.exists("issues", lambda x: x["level"] == "error"))
    columns = out.columns
    out = apply_rules(out, schema.rules, record_context(schema, columns, as_of))
    confidence = mean_confidence(F.col(details)) if details else F.lit(None).cast("double")
    out = out.withColumn("score", score_of(completeness_of(schema, columns, held_to="_held_to" if present else None), F.col("valid"), confidence))
    out = out.withColumn("status", status_of(F.col("valid"), F.col("rules"))).withColumn("state", document_state(F.col("valid"), F.col("issues"), F.col("rules")))
    return out.withColumn("report", markdown(schema)).drop("_held_to")


def rule_holds(records: DataFrame, rules, context: dict[str, Value], keys: list[str]) -> DataFrame:
    """One row for each rule of each record: keys, rule_id, holds. Nothing else of a rule is carried through the records."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    rows = records.select(*keys, F.posexplode(F.array(*[compile_rule(r.expression, context) for r in rules])).alias("_at", "holds"))
    return rows.select(*keys, F.get(ids, F.col("_at")).alias("rule_id"), "holds")


def rule_rates(records: DataFrame, rules, context: dict[str, Value], by: list[str]) -> DataFrame:
    """by, rule_id, n, passed, failed, unknown: one row for each rule of each group, counted in one aggregate and unfolded after it.

    Null keys are a group; an empty table has no groups; rules of equal ids each have their row.
    """
    if not rules:
        return records.where("false").select(*by, F.lit("").alias("rule_id"), *[F.lit(0).cast("long").alias(c) for c in ("n", "passed", "failed", "unknown")])
    holds = [(r, f"_{i}") for i, r in enumerate(rules)]
    held = records.select(*by, *[compile_rule(r.expression, context).alias(c) for r, c in holds])
    counted = held.groupBy(*by).agg(F.count("*").alias("n"), *[F.struct(F.count_if(c).alias("passed"), F.count_if(~F.col(c)).alias("failed")).alias(c) for _, c in holds])
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col("n"), F.col(f"{c}.passed").alias("passed"), F.col(f"{c}.failed").alias("failed"), (F.col("n") - F.col(f"{c}.passed") - F.col(f"{c}.failed")).alias("unknown")) for r, c in holds])
    return counted.select(*by, F.inline(rows))


def rule_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each rule of each record: keys, rule_id, severity, holds."""
    return records.select(*keys, F.explode("rules").alias("r")).select(*keys, F.col("r.id").alias("rule_id"), "r.severity", "r.holds")
