import pytest

from ledgerlens.operators.normalize import normalize
from ledgerlens.operators.validate import validate
from ledgerlens.plans.builtin import INVOICE, MORTGAGE
from ledgerlens.plans.schema import Constraint, Field, Schema, infer_schema, schema_from


def one(spark, schema, **fields):
    names = list(fields)
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in fields.items()))
    assert names
    return normalize(df, schema).first()


def test_local_formats(spark):
    r = one(spark, INVOICE, base_imponible=" 2.445,37 EUR ", tipo_iva="4", cuota_iva="97,81", importe_total="2.543,18", fecha_expedicion="25/03/2026", num_factura="N/A")
    assert (r.base_imponible, r.tipo_iva, r.fecha_expedicion, r.num_factura) == (2445.37, 4, "2026-03-25", None)
    kinds = [(c.field, c.kind) for c in r.changes]
    assert ("base_imponible", "trim") in kinds and ("fecha_expedicion", "parse") in kinds and ("num_factura", "coerce") in kinds
    assert r.autocorrections == []


def test_tax_rate_repairs(spark):
    r = one(spark, INVOICE, base_imponible="1000", tipo_iva="49", cuota_iva="40", importe_total="1040")
    assert r.tipo_iva == 4
    r = one(spark, INVOICE, base_imponible="1000", tipo_iva="77", cuota_iva="210", importe_total="1210")
    assert r.tipo_iva == 21
    r = one(spark, INVOICE, base_imponible="1000", tipo_iva="21", cuota_iva="21000", importe_total="121000")
    assert (r.cuota_iva, r.importe_total) == (210.0, 1210.0)
    assert [c.field for c in r.autocorrections] == ["cuota_iva", "importe_total"]


def test_mortgage_rescaling(spark):
    r = one(spark, MORTGAGE, tasa_interes="360", tae="444", monto_prestamo_eur=None)
    assert (r.tasa_interes, r.tae) == (3.6, 4.44)
    r = one(spark, MORTGAGE, monto_prestamo_eur="3.6", tasa_interes=None)
    assert (r.tasa_interes, r.monto_prestamo_eur) == (3.6, None)
    r = one(spark, MORTGAGE, monto_prestamo_eur="157.52", cuota_mensual_eur="78260", tasa_interes="3.6", plazo_meses="252", ingresos_mensuales_eur="3590")
    assert (r.monto_prestamo_eur, r.cuota_mensual_eur) == (157520.0, 782.6)


def test_unreadable_is_kept_and_reported(spark):
    df = spark.createDataFrame([("much", "-5")], "base_imponible string, importe_total string")
    r = validate(normalize(df, INVOICE), INVOICE).first()
    assert r.base_imponible is None and r.raw__base_imponible == "much"
    codes = {(i.field, i.code) for i in r.issues}
    assert ("base_imponible", "type") in codes and ("importe_total", "min") in codes and ("cuota_iva", "required") in codes
    assert ("base_imponible", "required") not in codes


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([("2.445,37", "4", "97,81", "2543.18", "2026-03-25")], "base_imponible string, tipo_iva string, cuota_iva string, importe_total string, fecha_expedicion string")
    once = normalize(df, INVOICE).drop("changes", "autocorrections")
    again = normalize(once.select([f.name for f in INVOICE.fields]), INVOICE)
    a, b = once.first(), again.first()
    assert all(a[f.name] == b[f.name] for f in INVOICE.fields)
    assert b.changes == []


def test_enum_and_document_kind(spark):
    s = Schema("x", fields=(Field("tipo_documento", "string", False, None, (Constraint("enum", ("DNI", "NIE")),)), Field("numero_documento")))
    assert one(spark, s, tipo_documento="d.n.i", numero_documento="12345678Z").tipo_documento == "DNI"
    assert one(spark, s, tipo_documento=None, numero_documento="X1234567L").tipo_documento == "NIE"
    assert one(spark, s, tipo_documento="tarjeta dni", numero_documento=None).tipo_documento == "DNI"


def test_both_dialects_and_inference():
    s = schema_from({"caso_uso": "c", "documentos": [{"tipo": "A", "campos": [{"nombre": "n", "tipo_dato": "int", "requerido": True, "validacion": {"rango_min": 1, "valores_permitidos": [1, 2]}, "patron": "^x$"}]}], "reglas_decision": [{"id": 1, "expresion": "n > 0", "severidad": "critica"}]})
    f = s.fields[0]
    assert (f.type, f.required, f.document_type) == ("integer", True, "A") and {c.kind for c in f.constraints} == {"regex", "min", "enum"}
    assert s.rules[0].key == "1" and s.for_document_type("B") is s
    s = schema_from({"name": "s", "fields": [{"name": "a", "type": "number", "rules": [{"kind": "max", "params": {"value": 3}}]}]})
    assert s.fields[0].values("max") == [3]
    assert [f.type for f in infer_schema("i", {"a": 1, "b": 1.5, "c": True, "d": "2024-01-01", "e": "x"}).fields] == ["integer", "number", "boolean", "date", "string"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "base_imponible string")
    assert validate(normalize(df, INVOICE), INVOICE).count() == 0


def test_money_search_needs_strictly_better(spark):
    r = one(spark, INVOICE, base_imponible="1000", tipo_iva="21", cuota_iva="210,10", importe_total="1210")
    assert r.cuota_iva == pytest.approx(210.1)
