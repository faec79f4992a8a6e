import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import derive, engine
from ledgerlens.operators.audit import audit
from ledgerlens.plans.builtin import IDENTITY, INVOICE, MORTGAGE

AS_OF = derive.REFERENCE_DATE


def bases(spark, schema, n=10):
    rows = spark.range(2 * n).select((F.col("id") % n).cast("int").alias("idx"), (F.col("id") < n).alias("compliant"), F.col("id").alias("case_no"))
    i = F.col("idx")
    own = {
        "credito_hipotecario": {"id_documento": F.lit("HIP-0001"), "nombre_cliente": F.lit("Ana"), "dni_cliente": F.lit("86473212N"), "monto_prestamo_eur": 90000.0 + i * 11111, "tasa_interes": 2.5 + i * 0.2, "fecha_emision": F.lit("2025-03-08")},
        "auditoria_fiscal": {"razon_social_emisor": F.lit("Mesa S.L."), "nif_emisor": F.lit("A2418382A"), "num_factura": F.lit("FAC-2026-0001"), "fecha_expedicion": F.lit("2026-03-25"), "base_imponible": 1000.5 + i * 77.7, "tipo_iva": F.element_at(F.array(*map(F.lit, (4, 10, 21))), i % 3 + 1)},
        "kyc_onboarding": {"nombre_titular": F.lit("M"), "primer_apellido": F.lit("O"), "segundo_apellido": F.lit("N"), "num_documento": F.lit("53864817D"), "fecha_nacimiento": F.lit("1992-12-08"), "domicilio_comprobante": F.lit("Ronda 59")},
    }[schema.name]
    return rows.withColumns(own)


@pytest.mark.parametrize("schema,make", [(MORTGAGE, derive.derive_mortgage), (INVOICE, derive.derive_invoice), (IDENTITY, derive.derive_identity)])
def test_planned_violations_are_found(spark, schema, make):
    got = audit(make(bases(spark, schema)), schema, as_of=AS_OF).select("compliant", "rules", "status", "autocorrections").collect()
    assert len(got) == 20
    for r in got:
        failed = {x.id for x in r.rules if x.holds is False}
        assert all(x.holds is not None for x in r.rules)
        # repaired figures may hide a break, and then say so
        fixed = {c.field for c in r.autocorrections}
        want = set() if r.compliant else set(derive.BROKEN[schema.name])
        assert failed == want or (fixed and failed < want), (failed, fixed)
        assert not r.compliant or r.status == "APROBADO"


INVOICE_TEXT = "Factura\nEmisor: Mesa S.L.\nA2418382A FAC-2026-0001 2026-03-25\nBase imponible: 2.445,37\nTipo IVA: 4%\nCuota IVA: 97,81\nTotal: 2.543,18"


def test_texts_to_audits(spark):
    docs = spark.createDataFrame([(1, INVOICE_TEXT), (2, "pasaporte 12345678Z 1990-01-02 2030-01-02"), (3, "nada"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in engine.audit_texts(docs, keys=["doc_id"], as_of=datetime.date(2026, 6, 12)).collect()}
    assert {i: r.schema_name for i, r in got.items()} == {1: "auditoria_fiscal", 2: "kyc_onboarding", 3: "credito_hipotecario", 4: "credito_hipotecario"}
    assert (got[1].status, got[1].document_type) == ("APROBADO", "FACTURA_PROVEEDOR") and got[3].status == "REVISAR"
    assert engine.audit_texts(docs.where("false"), keys=["doc_id"]).count() == 0


def test_case_files(spark):
    head, tail = INVOICE_TEXT.split("\nBase")
    docs = spark.createDataFrame([("c", 0, head), ("c", 1, "Base" + tail), ("d", 0, head)], "case_id string, doc_index int, text string")
    got = {r.case_id: r for r in engine.audit_cases(docs, INVOICE, as_of=datetime.date(2026, 6, 12)).collect()}
    assert (got["c"].status, got["c"].importe_total, got["d"].status) == ("APROBADO", 2543.18, "REVISAR")
