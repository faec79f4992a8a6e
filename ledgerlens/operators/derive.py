"""Synthetic cases: complete records, compliant or with planned violations, from base records and a case number.

The figures are fixed values: the rule outcomes of the derived records depend on them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE_DATE = datetime.date(2026, 6, 12)
# Rules that a violating record breaks. The purpose rule RK08 stays true, as a blank purpose is null once normalized.
BROKEN = {
    "credito_hipotecario": ("H04", "H05", "H06", "H07", "H08"),
    "auditoria_fiscal": ("RF01", "RF02", "RF03", "RF04", "RF05", "RF07"),
    "kyc_onboarding": ("RK01", "RK02", "RK04", "RK05", "RK06", "RK07"),
}


def _cents(c: Column) -> Column:
    return F.round(c, 2)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _either(good: Column, yes, no) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(good, as_column(yes)).otherwise(as_column(no))


def derive_mortgage(base: DataFrame, number: str = "idx", compliant: str = "compliant") -> DataFrame:
    """Records with id_documento, nombre_cliente, dni_cliente, monto_prestamo_eur, tasa_interes and fecha_emision completed."""
    i, good = F.col(number), F.col(compliant)
    amount, rate = F.col("monto_prestamo_eur"), F.col("tasa_interes")
    df = base.withColumns(
        {
            "plazo_meses": _either(good, (240 + i * 12).cast("bigint"), F.lit(0).cast("bigint")),
            "tae": _either(good, _cents(rate + 0.75 + i * 0.09), 29.5),
            "ingresos_mensuales_eur": _cents(_either(good, F.greatest(amount / 70, 3400.0 + i * 190), F.greatest(amount / 120, 2100.0 + i * 80))),
            "gastos_mensuales_eur": _cents(_either(good, 650.0 + i * 55, 980.0 + i * 65)),
            "comision_apertura_eur": _cents(amount * _either(good, 0.0045, 0.011)),
            "fein_entregada": good,
            "fiae_entregada": good,
            "sistema_amortizacion": F.lit("frances"),
        }
    )
    income = F.col("ingresos_mensuales_eur")
    df = df.withColumn("cuota_mensual_eur", _cents(_either(good, F.least(income * 0.29, amount / F.nullif(F.col("plazo_meses"), F.lit(0)) * 1.22), income * 0.54)))
    return df.withColumn("ratio_endeudamiento", _cents(_either(good, F.least((F.col("cuota_mensual_eur") + F.col("gastos_mensuales_eur")) / income, F.lit(0.39)), 0.58)))


def derive_invoice(base: DataFrame, number: str = "idx", compliant: str = "compliant", today: datetime.date = REFERENCE_DATE) -> DataFrame:
    """Records with razon_social_emisor, nif_emisor, num_factura, fecha_expedicion, base_imponible and tipo_iva completed."""
    i, good, day = F.col(number).cast("int"), F.col(compliant), F.lit(today)
    issue = _either(good, F.least(F.to_date("fecha_expedicion"), F.date_sub(day, i + 10)), F.date_add(day, i + 25))
    df = base.withColumn("base_imponible", _cents(F.col("base_imponible").cast("double")))
    net = F.col("base_imponible")
    df = df.withColumns(
        {
            "_issue": issue,
            "tipo_iva": _either(good, F.col("tipo_iva").cast("bigint"), F.lit(15).cast("bigint")),
            "retencion_irpf": F.when(good & (i % 2 == 0) & (_cents(net * 0.07) > 0), _cents(net * 0.07)),
            "num_factura": _either(good, F.col("num_factura"), ""),
            "serie_factura": _either(good, "SER-A", "SER-X"),
            "direccion_emisor": _either(good, F.concat(F.lit("Calle Control Interno "), i + 40, F.lit(", Madrid")), F.concat(F.lit("Avenida Revision Fiscal "), i + 80, F.lit(", Valencia"))),
            "nombre_destinatario": F.concat(_either(good, "Cliente Auditoria ", "Cliente Riesgo "), _two(i), F.lit(" S.L.")),
            "nif_destinatario": F.concat(F.lit("B"), _either(good, 7000000 + i, 7100000 + i).cast("string"), F.char(_either(good, 65 + i, 70 + i))),
            "descripcion_operacion": F.concat(_either(good, "Servicios profesionales de auditoria documental lote ", "Servicios con incidencia de control fiscal "), _two(i)),
        }
    )
    df = df.withColumn("cuota_iva", _cents(_either(good, net * F.col("tipo_iva") / 100, net * 0.12)))
    total = _either(good, net + F.col("cuota_iva") - F.coalesce("retencion_irpf", F.lit(0.0)), net + net * 0.12 + 45.5)
    df = df.withColumns({"importe_total": _cents(total), "fecha_expedicion": F.date_format("_issue", "yyyy-MM-dd"), "fecha_operacion": F.date_format(_either(good, F.date_sub("_issue", 2), F.date_add("_issue", 4)), "yyyy-MM-dd")})
    return df.drop("_issue")


def derive_identity(base: DataFrame, number: str = "idx", compliant: str = "compliant", today: datetime.date = REFERENCE_DATE) -> DataFrame:
    """Records with names, num_documento, fecha_nacimiento and domicilio_comprobante completed."""
    i, good, day = F.col(number).cast("int"), F.col(compliant), F.lit(today)
    iso = lambda a, b: F.date_format(_either(good, a, b), "yyyy-MM-dd")
    return base.withColumns(
        {
            "fecha_nacimiento": iso(F.to_date("fecha_nacimiento"), F.date_sub(day, i * 7 + 365 * 16)),
            "fecha_expedicion": iso(F.date_sub(day, i * 30 + 1000), F.date_add(day, i + 10)),
            "fecha_caducidad": iso(F.date_add(day, i * 12 + 900), F.date_sub(day, i + 40)),
            "nacionalidad": F.lit("Espana"),
            "pais_residencia": F.lit("Espana"),
            "autoridad_emisora": F.lit("Direccion General de la Policia"),
            "actividad_economica": _either(good, "Profesional por cuenta ajena", "Actividad no verificada"),
            "proposito_relacion": _either(good, "Apertura de cuenta y verificacion de identidad", ""),
            "pep": ~good,
            "titular_real_identificado": good,
            "coincidencia_sanciones": ~good,
            "nivel_riesgo": F.lit("bajo"),
        }
    )
