"""Validation of normalized records: required, type, constraints; issues in schema order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numbers
from ledgerlens.functions.text import is_empty
from ledgerlens.operators.normalize import RAW
from ledgerlens.plans.schema import Field, Schema

ISSUE = "struct<level:string,field:string,code:string,message:string>"
# What each type check says.
TYPE_MESSAGES = {
    "string": "Se esperaba string.", "number": "Se esperaba number.", "integer": "Se esperaba integer.", "boolean": "Se esperaba boolean.",
    "date": "Se esperaba date (ISO: YYYY-MM-DD).", "datetime": "Se esperaba datetime (ISO).",
}


def _issue(test: Column, f: Field, code: str, message: str) -> Column:
    row = F.struct(F.lit("error").alias("level"), F.lit(f.name).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"))
    return F.when(F.coalesce(test, F.lit(False)), row.cast(ISSUE))


def _said(v) -> str:
    return str(list(v)) if isinstance(v, tuple) else str(v)


def field_issues(f: Field, value: Column, raw: Column) -> list[Column]:
    """Issues of one field; value is typed, raw the text that was unreadable as its type."""
    text = F.coalesce(value.cast("string"), raw)
    gone = is_empty(text)
    out = [_issue(gone, f, "required", "Campo requerido ausente.")] if f.required else []
    number = F.coalesce(value.cast("double") if f.type in ("number", "integer") else numbers.strict_number(value.cast("string")), numbers.strict_number(raw))
    if f.type == "number":
        out.append(_issue(~gone & number.isNull(), f, "type", TYPE_MESSAGES["number"]))
    elif f.type == "integer":
        whole = F.coalesce(value.cast("bigint"), numbers.as_integer(numbers.strict_number(raw)))
        out.append(_issue(~gone & whole.isNull(), f, "type", TYPE_MESSAGES["integer"]))
    elif f.type == "boolean":
        out.append(_issue(~gone & value.isNull(), f, "type", TYPE_MESSAGES["boolean"]))
    elif f.type == "date":
        out.append(_issue(~gone & dates.parse_iso_date(text).isNull(), f, "type", TYPE_MESSAGES["date"]))
    elif f.type == "datetime":
        out.append(_issue(~gone & dates.iso_datetime(text).isNull(), f, "type", TYPE_MESSAGES["datetime"]))
    for c in f.constraints:
        if c.kind == "min":
            out.append(_issue(~gone & (number < float(c.value)), f, "min", f"Debe ser >= {c.value}."))
        elif c.kind == "max":
            out.append(_issue(~gone & (number > float(c.value)), f, "max", f"Debe ser <= {c.value}."))
        elif c.kind == "regex" and f.type in ("string", "date", "datetime"):
            out.append(_issue(~gone & ~text.rlike(rf"\A(?:{c.value})\z"), f, "regex", "No cumple el patrón esperado."))
        elif c.kind == "enum":
            wanted = [float(v) for v in c.value] if f.type in ("number", "integer") else [str(v) for v in c.value]
            own = F.coalesce(number.isin(*wanted), F.lit(False)) if f.type in ("number", "integer") else text.isin(*wanted)
            out.append(_issue(~gone & ~own, f, "enum", f"Valor no permitido. Permitidos: {_said(c.value)}."))
    return out


def validate(records: DataFrame, schema: Schema) -> DataFrame:
    """Adds issues array<struct<level,field,code,message>> and valid. Fields that are no columns are empty."""
    have = set(records.columns)
    rows = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in have else F.lit(None).cast("string")
        raw = F.col(RAW + f.name) if RAW + f.name in have else F.lit(None).cast("string")
        rows += field_issues(f, value, raw)
    out = records.withColumn("issues", F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast(f"array<{ISSUE}>"))
    return out.withColumn("valid", ~F.exists("issues", lambda x: x["level"] == "error"))


def issue_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each issue: keys, position, level, field, code, message."""
    return records.select(*keys, F.posexplode("issues").alias("position", "issue")).select(*keys, "position", "issue.level", "issue.field", "issue.code", "issue.message")


def change_rows(records: DataFrame, keys: list[str], column: str = "autocorrections") -> DataFrame:
    """One row for each change: keys, position, field, kind, before, after."""
    return records.select(*keys, F.posexplode(column).alias("position", "c")).select(*keys, "position", "c.field", "c.kind", "c.before", "c.after")


# Many schemas: constraints as rows.
CHECK = "struct<code:string,kind:string,low:double,high:double,pattern:string,numbers:array<double>,texts:array<string>,message:string>"
CHECKED_FIELD = f"struct<field:string,type:string,required:boolean,checks:array<{CHECK}>>"
#: Verdicts that one long holds.
PACKED = 63


def constraint_rows(spark, schemas: list[Schema]) -> DataFrame:
    """(schema, fields array<CHECKED_FIELD>), one row a schema: what ``validate_many`` joins to records. Formats are not checked, as ever."""
    rows = []
    for s in schemas:
        fields = []
        for f in s.fields:
            checks = []
            numeric = f.type in ("number", "integer")
            for c in f.constraints:
                if c.kind == "min":
                    checks.append(("min", "low", float(c.value), None, None, None, None, f"Debe ser >= {c.value}."))
                elif c.kind == "max":
                    checks.append(("max", "high", None, float(c.value), None, None, None, f"Debe ser <= {c.value}."))
                elif c.kind == "regex" and f.type in ("string", "date", "datetime"):
                    checks.append(("regex", "pattern", None, None, rf"\A(?:{c.value})\z", None, None, "No cumple el patrón esperado."))
                elif c.kind == "enum":
                    own = ([float(v) for v in c.value], None) if numeric else (None, [str(v) for v in c.value])
                    checks.append(("enum", "numbers" if numeric else "texts", None, None, None, *own, f"Valor no permitido. Permitidos: {_said(c.value)}."))
            fields.append((f.name, f.type, f.required, checks))
        rows.append((s.name, fields))
    return spark.createDataFrame(rows, f"schema string, fields array<{CHECKED_FIELD}>")


def _field_verdicts(f: Column, values: Column) -> Column:
    """array<struct<bad, issue>> of one field: required, type, then its checks in order."""
    name, kind = f["field"], f["type"]
    text = values[name]
    number = numbers.strict_number(text)
    gone = is_empty(text)
    said = F.create_map(*[F.lit(x) for pair in TYPE_MESSAGES.items() for x in pair])
    fits = (
        F.when(kind == "number", number.isNotNull())
        .when(kind == "integer", numbers.as_integer(number).isNotNull())
        .when(kind == "boolean", text.isin("true", "false"))
        .when(kind == "date", dates.parse_iso_date(text).isNotNull())
        .when(kind == "datetime", dates.iso_datetime(text).isNotNull())
        .otherwise(True)
    )

    def row(bad: Column, code: Column, message: Column) -> Column:
        issue = F.struct(F.lit("error").alias("level"), name.alias("field"), code.alias("code"), message.alias("message"))
        return F.struct(F.coalesce(bad, F.lit(False)).alias("bad"), issue.alias("issue"))

    def check(c: Column) -> Column:
        bad = (
            F.when(c["kind"] == "low", number < c["low"])
            .when(c["kind"] == "high", number > c["high"])
            .when(c["kind"] == "pattern", ~F.rlike(text, c["pattern"]))
            .when(c["kind"] == "numbers", ~F.coalesce(F.array_contains(c["numbers"], number), F.lit(False)))
            .when(c["kind"] == "texts", ~F.array_contains(c["texts"], text))
        )
        return row(~gone & bad, c["code"], c["message"])

    own = F.array(row(f["required"] & gone, F.lit("required"), F.lit("Campo requerido ausente.")), row(~gone & ~fits, F.lit("type"), said[kind]))
    return F.concat(own, F.transform(f["checks"], check))


def validate_many(records: DataFrame, constraints: DataFrame, *, schema_col: str = "schema", values_col: str = "values") -> DataFrame:
    """records with issues, valid and verdicts: each held to the schema that its schema_col names, however many schemas there are.

    values_col is a map<string,string> of the fields as texts. constraints are rows as ``constraint_rows`` gives them, read from a
    table if need be: one join by schema, and one expression that goes through a record's own fields, so that the plan has the same size
    for one schema and for a thousand. Issues come in the order of fields, and within one as ``validate`` has them. verdicts
    array<long> packs the same: bit i of the record's verdicts, PACKED to a long, is set where check i fails, counting required, type and the checks of
    each field in turn. A record whose schema is null or unknown has no issues, is not valid and has null verdicts.
    """
    theirs = constraints.select(F.col("schema").alias("_schema"), F.col("fields").alias("_fields")).dropDuplicates(["_schema"])
    met = records.join(theirs, F.col(f"`{schema_col}`") == F.col("_schema"), "left")
    values = F.coalesce(F.col(f"`{values_col}`"), F.create_map().cast("map<string,string>"))
    found = met.withColumn("_verdicts", F.flatten(F.transform("_fields", lambda f: _field_verdicts(f, values))))
    bits = F.transform("_verdicts", lambda v, i: F.when(v["bad"], F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(PACKED)).cast("int"))).otherwise(F.lit(0).cast("long")))
    groups = F.sequence(F.lit(0), F.greatest(F.floor((F.size("_verdicts") - 1) / PACKED), F.lit(0)).cast("int"))
    packed = F.transform(groups, lambda g: F.aggregate(F.slice(F.col("_bits"), g * PACKED + 1, F.lit(PACKED)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    out = found.withColumn("_bits", bits).withColumns(
        {
            "issues": F.coalesce(F.transform(F.filter("_verdicts", lambda v: v["bad"]), lambda v: v["issue"]), F.array().cast(f"array<{ISSUE}>")),
            "valid": F.coalesce(~F.exists("_verdicts", lambda v: v["bad"]), F.lit(False)),
            "verdicts": F.when(F.col("_bits").isNotNull(), packed),
        }
    )
    return out.drop("_schema", "_fields", "_verdicts", "_bits")
