"""Normalization of wide records, one Column pipeline a field.

Input columns are the schema's fields, as texts or as typed columns; missing ones are null. Output:
each field typed, ``raw__<field>`` with the text that could not be read as its type (null
otherwise), ``changes`` and ``autocorrections``. A value that is there but unreadable is
thus kept apart from null, as validation and rules need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import dates, numbers
from ledgerlens.functions.text import NULL_TOKENS, is_empty, strip
from ledgerlens.plans.schema import Field, Schema

RAW = "raw__"
TYPED = {"number": "double", "integer": "bigint", "boolean": "boolean"}
CHANGE = "struct<field:string,kind:string,before:string,after:string>"


def _change(test: Column, name: str, kind: str, before: Column, after: Column) -> Column:
    row = F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), before.cast("string").alias("before"), after.cast("string").alias("after"))
    return F.when(F.coalesce(test, F.lit(False)), row.cast(CHANGE))


def canonical(text: Column, values) -> Column:
    """The allowed value that the text means: equal in upper case with separators as one space; null if none."""
    s = strip(F.regexp_replace(F.upper(text), r"(?U)[\s.\-_/]+", " "))
    out = [F.when(s == str(v).upper(), F.lit(str(v))) for v in values]
    for kind in ("DNI", "NIE", "PASAPORTE"):
        out += [F.when(F.contains(s, F.lit(kind)), F.lit(str(v))) for v in values if str(v).upper() == kind]
    return F.coalesce(*out)


def normalize_field(f: Field, c: Column, source: str) -> tuple[Column, Column | None, list[Column]]:
    """(typed value, unreadable text or None, changes) of one field whose column has the type ``source``."""
    if source != "string":
        if f.type in ("number", "integer") and source != "boolean":
            number = c.cast("double")
            if f.type == "number":
                return number, None, []
            whole = numbers.as_integer(number)
            left = F.when(number.isNotNull() & whole.isNull(), c.cast("string"))
            changed = F.lit(source in ("double", "float") or source.startswith("decimal")) & whole.isNotNull()
            return whole, left, [_change(changed, f.name, "parse", c, whole)]
        if f.type == "boolean" and source == "boolean":
            return c, None, []
        if f.type == "date" and source == "date" or f.type == "datetime" and source.startswith("timestamp"):
            text = F.date_format(c, "yyyy-MM-dd") if f.type == "date" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            return text, None, [_change(c.isNotNull(), f.name, "parse", c, text)]
        c = c.cast("string")
    present = F.when(~is_empty(c), c)
    trimmed = strip(present)
    changes = [_change(trimmed != present, f.name, "trim", present, trimmed)]
    token = F.lower(trimmed).isin(*NULL_TOKENS)
    changes.append(_change(token, f.name, "coerce", trimmed, F.lit(None)))
    value = F.when(~token, trimmed)
    for values in f.values("enum")[:1]:
        own = canonical(value, values)
        changes.append(_change(own != value, f.name, "coerce", value, own))
        value = F.coalesce(own, value)
    if f.type == "string":
        return value, None, changes
    kind = "parse"
    if f.type == "number":
        after = numbers.parse_number(value)
    elif f.type == "integer":
        after = numbers.as_integer(numbers.parse_number(value))
    elif f.type == "boolean":
        after, kind = dates.parse_flag(value), "coerce"
    elif f.type == "date":
        text = F.date_format(dates.parse_date(value), "yyyy-MM-dd")
        return F.coalesce(text, value), None, [*changes, _change(text != value, f.name, "parse", value, text)]
    else:
        text = dates.iso_datetime(value)
        return F.coalesce(text, value), None, [*changes, _change(text != value, f.name, "parse", value, text)]
    return after, F.when(after.isNull(), value), [*changes, _change(after.isNotNull(), f.name, kind, value, after)]


def normalize(records: DataFrame, schema: Schema, reconcile: bool = True) -> DataFrame:
    """All columns that are no fields, then the typed fields, their unreadable texts, changes and autocorrections."""
    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    names = [f.name for f in schema.fields]
    keep = [c for c in records.columns if c not in names]
    read, typed, left, changes = [], [], [], []
    for f in schema.fields:
        c = F.col(f.name) if f.name in kinds else F.lit(None).cast("string")
        value, raw, own = normalize_field(f, c, kinds.get(f.name, "string"))
        # one struct a field is worked out in a step of its own, and then taken apart
        raw = F.lit(None).cast("string") if raw is None else raw
        read.append(F.struct(value.cast(TYPED.get(f.type, "string")).alias("value"), raw.cast("string").alias("raw")).alias(f"read__{f.name}"))
        typed.append(F.col(f"read__{f.name}.value").alias(f.name))
        left.append(F.col(f"read__{f.name}.raw").alias(RAW + f.name))
        # what the field read before, for the reconciliations
        left.append((c.cast("string") if kinds.get(f.name, "string") == "string" else F.lit(None).cast("string")).alias(f"text__{f.name}"))
        left.append((c.cast("double") if kinds.get(f.name, "string") not in ("string", "boolean", "date") else F.lit(None).cast("double")).alias(f"number__{f.name}"))
        changes += own
    own = [n for n in names if n in kinds]
    out = records.select(*keep, *own, *read, F.filter(F.array(*changes), lambda x: x.isNotNull()).alias("changes"))
    out = out.select(*keep, *typed, *left, "changes")
    out = _document_kind(out, schema)
    if reconcile and schema.name == "auditoria_fiscal":
        out = reconcile_invoice(out, schema)
    if reconcile and schema.name == "credito_hipotecario":
        out = reconcile_mortgage(out)
    out = out.withColumn("autocorrections", F.filter("changes", lambda x: x["kind"] == "reconcile"))
    return out.select(*keep, *names, *[RAW + n for n in names], "changes", "autocorrections")


def _document_kind(df: DataFrame, schema: Schema) -> DataFrame:
    """Infers tipo_documento by the form of numero_documento, for schemas that have both."""
    kind = schema.field("tipo_documento")
    if not kind or not schema.field("numero_documento") or not kind.values("enum"):
        return df
    allowed = [str(v) for v in kind.values("enum")[0]]
    n = F.upper(strip(F.col("numero_documento")))
    tests = [(p, next((a for a in allowed if a.upper() == name), None)) for name, p in (("DNI", r"\A\d{8}[A-Z]\z"), ("NIE", r"\A[XYZ]\d{7}[A-Z]\z"))]
    found = [F.when(n.rlike(p), F.lit(a)) for p, a in tests if a]
    if not found:
        return df
    current = F.col("tipo_documento")
    new = F.when(current.isNull() | ~current.isin(*allowed), F.coalesce(*found))
    return _put(df, "tipo_documento", F.coalesce(new, current), new.isNotNull(), "coerce")


def _put(df: DataFrame, name: str, value: Column, changed: Column, kind: str = "reconcile") -> DataFrame:
    """Sets a field and logs the change; an unreadable text goes when a value comes."""
    before = F.coalesce(F.col(name).cast("string"), F.col(RAW + name))
    log = _change(changed, name, kind, before, value)
    df = df.withColumns({"_new": value, "_log": log})
    df = df.withColumns({name: F.col("_new"), RAW + name: F.when(F.col("_log").isNull(), F.col(RAW + name)), "changes": F.when(F.col("_log").isNull(), F.col("changes")).otherwise(F.concat("changes", F.array("_log")))})
    return df.drop("_new", "_log")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def reconcile_invoice(df: DataFrame, schema: Schema) -> DataFrame:
    """Repairs the tax rate by its OCR tail or by the amounts, then quota, total and withholding by each other."""
    enum = (schema.field("tipo_iva") or Field("")).values("enum")
    rates = [int(v) for v in enum[0]] if enum else []
    if not rates or any(schema.field(n) is None for n in ("base_imponible", "cuota_iva", "importe_total", "retencion_irpf")):
        return df
    current = F.col("tipo_iva")
    compact = F.regexp_replace(F.coalesce(F.col("text__tipo_iva"), F.col("number__tipo_iva").cast("bigint").cast("string"), F.lit("")), r"(?U)\s+", "")
    now = strip(F.coalesce(current.cast("string"), F.col(RAW + "tipo_iva"), F.lit("")))
    tails = [F.when(source.rlike(rf"\A{r}[%‰º°oOgGqQ9]{{1,2}}\z"), F.lit(r)) for source in (compact, now) for r in sorted(rates, key=lambda r: -len(str(r)))]
    tail = F.coalesce(*tails)
    legal = F.coalesce(current.isin(*rates), F.lit(False))
    implied = numbers.inferred_rate(F.col("base_imponible"), F.col("cuota_iva"), F.col("importe_total"), F.col("retencion_irpf"), rates)
    new = F.coalesce(tail, F.when(~legal, implied)).cast("bigint")
    df = _put(df, "tipo_iva", F.coalesce(new, current), new.isNotNull() & _differs(new, current))

    def settle(df: DataFrame, name: str, expected: Column) -> DataFrame:
        new = numbers.nearest_money(F.col(name), expected, F.col(f"number__{name}"), F.col(f"text__{name}"))
        return _put(df, name, new, _differs(new, F.col(name)))

    base = F.col("base_imponible")
    df = settle(df, "cuota_iva", F.round(base * (F.col("tipo_iva") / 100.0), 2))
    df = settle(df, "importe_total", F.round(base + F.col("cuota_iva") - F.coalesce("retencion_irpf", F.lit(0.0)), 2))
    owed = F.round(base + F.col("cuota_iva") - F.col("importe_total"), 2)
    return settle(df, "retencion_irpf", F.when(owed >= 0, owed))


def pair_score(amount: Column, payment: Column, a_shift: Column, p_shift: Column, rate: Column, months: Column, income: Column) -> Column:
    """How odd an amount and a payment look together; lower is better."""
    one = F.lit(1.0)
    score = F.when(amount.isNull(), 250.0).otherwise(a_shift + F.when(amount <= 0, 500.0).when(amount < 10000.0, 60.0 + (10000.0 - amount) / 1000.0).otherwise(0.0))
    score = score + F.when(payment.isNull(), 50.0).otherwise(p_shift + F.when(payment <= 0, 500.0).when(payment < 100.0, 40.0 + (100.0 - payment) / 10.0).otherwise(0.0))
    paid = payment * months
    low = F.when(paid < amount * 0.95, 200.0 + (amount * 0.95 - paid) / F.greatest(amount, one) * 20.0)
    high = F.when(paid > amount * 4.5, 30.0 + (paid - amount * 4.5) / F.greatest(amount, one) * 5.0)
    due = numbers.monthly_payment(amount, rate, months)
    off = F.abs(payment - due) / F.greatest(due, one) * 10.0
    share = F.when(income > 0, payment / income)
    burden = F.when(share > 0.8, 40.0 + (share - 0.8) * 20.0)
    zero = F.lit(0.0)
    return score + F.coalesce(low, zero) + F.coalesce(high, zero) + F.coalesce(off, zero) + F.coalesce(burden, zero)


def reconcile_mortgage(df: DataFrame) -> DataFrame:
    """Puts rescaled figures right: rate, APR, term, four amounts, then amount and payment together."""

    def settle(df: DataFrame, name: str, low: Column | None, high: Column | None, digits: int) -> DataFrame:
        new = numbers.rescaled(F.col(name).cast("double"), F.col(f"number__{name}"), F.col(f"text__{name}"), low, high, digits)
        new = F.bround(new, 0).cast("bigint") if digits == 0 else new
        return _put(df, name, new, _differs(new, F.col(name)))

    df = settle(df, "tasa_interes", F.lit(0.0), F.lit(20.0), 4)
    amount = F.col("monto_prestamo_eur")
    # a small amount where the rate is missing is the rate
    moved = F.coalesce(F.col("tasa_interes").isNull() & (amount > 0) & (amount <= 20.0), F.lit(False))
    df = df.withColumn("_moved", F.when(moved, amount))
    df = _put(df, "tasa_interes", F.coalesce(F.round("_moved", 4), F.col("tasa_interes")), F.col("_moved").isNotNull())
    df = _put(df, "monto_prestamo_eur", F.when(F.col("_moved").isNull(), amount), F.col("_moved").isNotNull()).drop("_moved")
    df = settle(df, "tae", F.coalesce("tasa_interes", F.lit(0.0)), F.lit(25.0), 4)
    df = settle(df, "plazo_meses", F.lit(1.0), F.lit(480.0), 0)
    # The ranges of the four amounts.
    for name, low, high in (("ingresos_mensuales_eur", 300.0, 100000.0), ("gastos_mensuales_eur", 0.0, 50000.0), ("comision_apertura_eur", 0.0, 50000.0), ("ratio_endeudamiento", 0.0, 1.0)):
        df = settle(df, name, F.lit(low), F.lit(high), 2)
    rate, months, income = F.col("tasa_interes"), F.col("plazo_meses").cast("double"), F.col("ingresos_mensuales_eur")
    of = lambda n: numbers.scaled_candidates(numbers.seeds_of(F.col(f"number__{n}"), F.col(f"text__{n}")), 2)
    payment, zero = F.col("cuota_mensual_eur"), F.lit(0)
    df = df.withColumns({"_a": F.filter(of("monto_prestamo_eur"), lambda x: x["value"] > 0), "_p": F.filter(of("cuota_mensual_eur"), lambda x: x["value"] > 0)})
    rated = F.flatten(
        F.transform(
            "_a",
            lambda a, i: F.transform(
                F.col("_p"),
                lambda p, j: F.struct(pair_score(a["value"], p["value"], a["shift"], p["shift"], rate, months, income).alias("score"), i.alias("i"), j.alias("j"), a["value"].alias("amount"), p["value"].alias("payment")),
            ),
        )
    )
    df = df.withColumns({"_best": F.array_min(rated), "_now": pair_score(amount, payment, zero, zero, rate, months, income)})
    use = F.coalesce(months.isNotNull() & (rate.isNotNull() | income.isNotNull()) & (F.col("_best.score") < F.col("_now")), F.lit(False))
    df = df.withColumn("_best", F.when(use, F.col("_best")))
    for name, part in (("monto_prestamo_eur", "amount"), ("cuota_mensual_eur", "payment")):
        new = F.col(f"_best.{part}")
        moved = new.isNotNull() & F.coalesce(F.abs(new - F.col(name)) > 0.01, F.lit(True))
        df = _put(df, name, F.when(moved, F.round(new, 2)).otherwise(F.col(name)), moved)
    return df.drop("_a", "_p", "_best", "_now")
