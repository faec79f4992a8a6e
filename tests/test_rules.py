import datetime

import pytest

from ledgerlens.operators import audit as rules_of
from ledgerlens.operators.audit import audit
from ledgerlens.operators.normalize import normalize
from ledgerlens.plans.builtin import IDENTITY, INVOICE, MORTGAGE, SCHEMAS
from ledgerlens.plans.rules import columns_context, compile_rule
from ledgerlens.plans.schema import DecisionRule

AS_OF = datetime.date(2026, 6, 12)

GOOD = {
    "credito_hipotecario": dict(id_documento="HIP-0001", nombre_cliente="Armida", dni_cliente="86473212N", monto_prestamo_eur="157520.6", tasa_interes="3.6", tae="4.44", plazo_meses="252", cuota_mensual_eur="762.6", ingresos_mensuales_eur="3590", gastos_mensuales_eur="705", ratio_endeudamiento="0.39", comision_apertura_eur="708.84", fein_entregada="true", fiae_entregada="si", sistema_amortizacion="frances", fecha_emision="2025-03-08"),
    "auditoria_fiscal": dict(razon_social_emisor="Mesa S.L.", nif_emisor="A2418382A", num_factura="FAC-2026-0001", fecha_expedicion="2026-03-25", fecha_operacion="2026-03-23", descripcion_operacion="Servicios", base_imponible="2445.37", tipo_iva="4", cuota_iva="97.81", retencion_irpf=None, importe_total="2543.18"),
    "kyc_onboarding": dict(nombre_titular="Marcia", primer_apellido="Osorio", segundo_apellido="M", num_documento="53864817D", fecha_nacimiento="1992-12-08", fecha_expedicion="2023-08-17", fecha_caducidad="2028-12-10", domicilio_comprobante="Ronda 59", proposito_relacion="Apertura", pep="false", titular_real_identificado="true", coincidencia_sanciones="false", nivel_riesgo="bajo"),
}
# rule -> fields whose absence makes it null
UNKNOWN = {
    "credito_hipotecario": {"H01": {"monto_prestamo_eur"}, "H02": {"tasa_interes"}, "H04": {"tae", "tasa_interes"}, "H05": {"plazo_meses"}, "H06": {"ingresos_mensuales_eur", "cuota_mensual_eur"}, "H07": {"ratio_endeudamiento"}},
    "auditoria_fiscal": {"RF01": {"cuota_iva", "base_imponible", "tipo_iva"}, "RF02": {"importe_total", "base_imponible", "cuota_iva"}, "RF04": {"fecha_expedicion"}, "RF05": {"fecha_operacion", "fecha_expedicion"}},
    "kyc_onboarding": {"RK01": {"fecha_nacimiento"}, "RK02": {"fecha_caducidad"}, "RK04": {"fecha_expedicion"}},
}
# what rules that are never null say without their field
ALONE = {"H03": ("id_documento", False), "H08": ("fein_entregada", True), "RF03": ("tipo_iva", False), "RF06": ("descripcion_operacion", True), "RF07": ("num_factura", False), "RK03": ("num_documento", True), "RK05": ("coincidencia_sanciones", True), "RK06": ("pep", True), "RK07": ("titular_real_identificado", True), "RK08": ("proposito_relacion", True)}


def records(spark, schema, rows):
    names = [f.name for f in schema.fields]
    data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "i int, " + ", ".join(f"{n} string" for n in names))


def outcomes(spark, schema, rows):
    got = {}
    # as loaded, without repairs that would fill what the test leaves out
    from ledgerlens.operators.audit import apply_rules, record_context

    df = normalize(records(spark, schema, rows), schema, reconcile=False)
    for r in apply_rules(df, schema.rules, record_context(schema, df.columns, AS_OF)).select("i", "rules").collect():
        got[r.i] = {x.id: x.holds for x in r.rules}
    return got


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_null_table_of_shipped_rules(spark, name):
    schema, good = SCHEMAS[name], GOOD[name]
    fields = [k for k in good]
    got = outcomes(spark, schema, [good, *[good | {f: None} for f in fields], {}])
    assert all(v is True for v in got[0].values())
    for i, f in enumerate(fields, 1):
        for rule, value in got[i].items():
            if f in UNKNOWN[name].get(rule, ()):
                assert value is None, (f, rule)
            elif rule in ALONE and ALONE[rule][0] == f:
                assert value is ALONE[rule][1], (f, rule)
            elif rule not in ALONE:
                assert value is True, (f, rule)
    empty = got[len(fields) + 1]
    assert all(empty[r] is None for r in UNKNOWN[name])
    assert all(empty[r] is v for r, (_, v) in ALONE.items() if r in empty)


def test_division_by_zero_and_unreadable(spark):
    got = outcomes(spark, MORTGAGE, [GOOD["credito_hipotecario"] | {"ingresos_mensuales_eur": "0"}, GOOD["credito_hipotecario"] | {"plazo_meses": "twelve"}])
    assert got[0]["H06"] is None
    assert got[1]["H05"] is None  # there, but no number


CASES = [
    ("a > 1 and b == 'x'", True),
    ("n == null", True),
    ("n == null or n > 0", None),
    ("n > 0", None),
    ("n in [1, 2]", False),
    ("a in (1, 2)", True),
    ("1 < a < 3", True),
    ("3 < a < n", False),
    ("1 < a < n", None),
    ("a / 0 > 1", None),
    ("a % 0 == 0", None),
    ("-7 % 3 == 2", True),
    ("not n", True),
    ("a < b", None),
    ("a == b", False),
    ("d - d2 > 0", None),
    ("(d - d2).days == 31", True),
    ("d.year == 2024 and d.month == 2", True),
    ("d > d2", True),
    ("coalesce(n, a) == 2", True),
    ("coalesce(n, b) == 'x'", True),
    ("max(a, 5) == 5 and min([a, 1]) == 1", True),
    ("max(a, n) > 0", None),
    ("round(2.5) == 2", True),
    ("round(a / 3, 2) == 0.67", True),
    ("abs(-a) == 2", True),
    ("f == 1", True),
    ("TRUE and f", True),
    ("b + 'y' == 'xy'", True),
    ("'x' in b", True),
    ("zzz > 1", None),
    ("a ** 2 > 1", None),
    ("__import__('os')", None),
    ("b[0] == 'x'", None),
    ("a if f else n", None),
    ("a >", None),
    ("n != null and n > 0", None),
    ("is_missing == null", None),
]


def test_language(spark):
    df = spark.sql("SELECT 2.0D AS a, 'x' AS b, CAST(NULL AS DOUBLE) AS n, true AS f, DATE'2024-02-15' AS d, '2024-01-15' AS d2")
    context = columns_context(df)
    row = df.select(*[compile_rule(e, context).alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).first()
    for i, (e, want) in enumerate(CASES):
        assert row[i] is want, e


def test_audit_report(spark):
    schema = INVOICE
    rows = [GOOD["auditoria_fiscal"], GOOD["auditoria_fiscal"] | {"num_factura": None, "nif_emisor": "bad"}]
    got = audit(records(spark, schema, rows), schema, as_of=AS_OF).orderBy("i").collect()
    assert (got[0].status, got[0].state, got[0].valid) == ("APROBADO", "OK", True)
    assert got[0].score == pytest.approx(0.6 * 10 / 15 + 0.4)
    assert (got[1].status, got[1].state, got[1].valid) == ("REVISAR", "CRITICO", False)
    assert [(x.field, x.code) for x in got[1].issues] == [("nif_emisor", "regex"), ("num_factura", "required")]
    assert "- [error] nif_emisor: No cumple el patrón esperado." in got[1].report
    assert "- RF07 — Número de factura informado: NO CUMPLE" in got[1].report


def test_identity_violations(spark):
    bad = GOOD["kyc_onboarding"] | dict(fecha_nacimiento="2015-01-01", fecha_caducidad="2020-01-01", fecha_expedicion="2030-01-01", coincidencia_sanciones="true", pep="true", titular_real_identificado="no", proposito_relacion="")
    got = outcomes(spark, IDENTITY, [bad])[0]
    assert {r for r, v in got.items() if v is False} == {"RK01", "RK02", "RK04", "RK05", "RK06", "RK07"}
    assert got["RK03"] is True and got["RK08"] is True


def test_rates_of_rules(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", None), (None, 9.0), (None, 9.0), ("b", None)], "g string, x double")
    rules = (DecisionRule("R1", "x > 5", "info", ""), DecisionRule("R2", "x == null or x < 5", "info", ""), DecisionRule("R1", "x > 0", "info", ""))
    got = sorted(map(repr, map(tuple, rules_of.rule_rates(rows, rules, columns_context(rows), ["g"]).collect())))
    held = rules_of.rule_holds(rows, rules, columns_context(rows), ["g"]).collect()
    assert len(got) == 9 and len(held) == 18
    assert sorted(got) == sorted(map(repr, [("a", "R1", 3, 1, 1, 1), ("a", "R1", 3, 2, 0, 1), ("a", "R2", 3, sum(r.holds is True for r in held if r.g == "a" and r.rule_id == "R2"), sum(r.holds is False for r in held if r.g == "a" and r.rule_id == "R2"), sum(r.holds is None for r in held if r.g == "a" and r.rule_id == "R2")),
        (None, "R1", 2, 2, 0, 0), (None, "R1", 2, 2, 0, 0), (None, "R2", 2, *[sum(r.holds is w for r in held if r.g is None and r.rule_id == "R2") for w in (True, False, None)]),
        ("b", "R1", 1, 0, 0, 1), ("b", "R1", 1, 0, 0, 1), ("b", "R2", 1, *[sum(r.holds is w for r in held if r.g == "b" and r.rule_id == "R2") for w in (True, False, None)])]))
    assert rules_of.rule_rates(rows.where("false"), rules, columns_context(rows), ["g"]).count() == 0
    none = rules_of.rule_rates(rows, (), columns_context(rows), ["g"])
    assert none.columns == ["g", "rule_id", "n", "passed", "failed", "unknown"] and none.count() == 0
