"""The three schemas that ship with the engine. Names, patterns, ranges and rule expressions are fixed values."""

from __future__ import annotations

from ledgerlens.plans.schema import Constraint, DecisionRule, Field, Schema


def _field(kind: str, name: str, type_: str = "string", required: bool = False, **checks) -> Field:
    return Field(name, type_, required, kind, tuple(Constraint(k, v) for k, v in checks.items()))


def _mortgage(name: str, type_: str = "string", required: bool = False, **checks) -> Field:
    return _field("CONTRATO_HIPOTECA", name, type_, required, **checks)


MORTGAGE = Schema(
    "credito_hipotecario",
    "1.0",
    (
        _mortgage("id_documento"),
        _mortgage("nombre_cliente", required=True),
        _mortgage("dni_cliente", required=True, regex="^[XYZ0-9][0-9]{7}[A-Z]$"),
        _mortgage("monto_prestamo_eur", "number", True, min=0.0),
        _mortgage("tasa_interes", "number", True, min=0.0),
        _mortgage("tae", "number", min=0.0),
        _mortgage("plazo_meses", "integer", min=1.0),
        _mortgage("cuota_mensual_eur", "number", min=0.0),
        _mortgage("ingresos_mensuales_eur", "number", min=0.0),
        _mortgage("gastos_mensuales_eur", "number", min=0.0),
        _mortgage("ratio_endeudamiento", "number", min=0.0, max=1.0),
        _mortgage("comision_apertura_eur", "number", min=0.0),
        _mortgage("fein_entregada", "boolean"),
        _mortgage("fiae_entregada", "boolean"),
        _mortgage("sistema_amortizacion"),
        _mortgage("fecha_emision", "date", True),
    ),
    (
        DecisionRule("H01", "monto_prestamo_eur > 0", "critica", "Importe de préstamo positivo"),
        DecisionRule("H02", "tasa_interes >= 0 and tasa_interes <= 20", "advertencia", "Tipo de interés en rango razonable (0-20%)"),
        DecisionRule("H03", "id_documento != null and id_documento != ''", "advertencia", "Documento con identificador presente"),
        DecisionRule("H04", "tae == null or (tae >= tasa_interes and tae <= 25)", "advertencia", "TAE en rango razonable cuando está informada"),
        DecisionRule("H05", "plazo_meses == null or plazo_meses > 0", "advertencia", "Plazo positivo cuando está informado"),
        DecisionRule("H06", "ingresos_mensuales_eur == null or cuota_mensual_eur == null or (ingresos_mensuales_eur > 0 and (cuota_mensual_eur / ingresos_mensuales_eur) <= 0.35)", "advertencia", "Esfuerzo financiero razonable cuando hay ingresos y cuota"),
        DecisionRule("H07", "ratio_endeudamiento == null or ratio_endeudamiento <= 0.4", "advertencia", "Ratio de endeudamiento razonable cuando está informado"),
        DecisionRule("H08", "(fein_entregada == null or fein_entregada == true) and (fiae_entregada == null or fiae_entregada == true)", "info", "FEIN y FIAE, si se informan, deben constar como entregadas"),
    ),
    ("CONTRATO_HIPOTECA",),
)


def _invoice(name: str, type_: str = "string", required: bool = False, **checks) -> Field:
    return _field("FACTURA_PROVEEDOR", name, type_, required, **checks)


INVOICE = Schema(
    "auditoria_fiscal",
    "1.0",
    (
        _invoice("razon_social_emisor", required=True),
        _invoice("direccion_emisor"),
        _invoice("nif_emisor", required=True, regex="^[A-HJNP-SUW][0-9]{7}[0-9A-J]$"),
        _invoice("nombre_destinatario"),
        _invoice("nif_destinatario"),
        _invoice("num_factura", required=True),
        _invoice("serie_factura"),
        _invoice("fecha_expedicion", "date", True),
        _invoice("fecha_operacion", "date"),
        _invoice("descripcion_operacion"),
        _invoice("base_imponible", "number", True, min=0.0),
        _invoice("tipo_iva", "integer", True, enum=(0, 4, 10, 21)),
        _invoice("cuota_iva", "number", True),
        _invoice("retencion_irpf", "number"),
        _invoice("importe_total", "number", True, min=0.0),
    ),
    (
        DecisionRule("RF01", "abs(cuota_iva - (base_imponible * (tipo_iva / 100))) <= 0.05", "advertencia", "Validación matemática del IVA"),
        DecisionRule("RF02", "abs(importe_total - (base_imponible + cuota_iva - coalesce(retencion_irpf, 0))) <= 0.05", "advertencia", "Consistencia del importe total facturado"),
        DecisionRule("RF03", "tipo_iva in [21, 10, 4, 0]", "critica", "Tipos de IVA legales"),
        DecisionRule("RF04", "fecha_expedicion <= fecha_actual", "advertencia", "Fecha de expedición no futura"),
        DecisionRule("RF05", "fecha_operacion == null or fecha_operacion <= fecha_expedicion", "advertencia", "La fecha de operación, si existe, no es posterior a la expedición"),
        DecisionRule("RF06", "descripcion_operacion == null or descripcion_operacion != ''", "info", "Descripción de operación presente cuando se informa"),
        DecisionRule("RF07", "num_factura != null and num_factura != ''", "critica", "Número de factura informado"),
    ),
    ("FACTURA_PROVEEDOR",),
)


def _identity(name: str, type_: str = "string", required: bool = False, **checks) -> Field:
    return _field("EXPEDIENTE_IDENTIDAD", name, type_, required, **checks)


IDENTITY = Schema(
    "kyc_onboarding",
    "1.0",
    (
        _identity("nombre_titular", required=True),
        _identity("primer_apellido", required=True),
        _identity("segundo_apellido", required=True),
        _identity("num_documento", required=True, regex="^[XYZ0-9][0-9]{7}[A-Z]$"),
        _identity("nacionalidad"),
        _identity("pais_residencia"),
        _identity("fecha_nacimiento", "date", True),
        _identity("fecha_expedicion", "date"),
        _identity("fecha_caducidad", "date", True),
        _identity("autoridad_emisora"),
        _identity("domicilio_comprobante", required=True),
        _identity("actividad_economica"),
        _identity("proposito_relacion"),
        _identity("pep", "boolean"),
        _identity("titular_real_identificado", "boolean"),
        _identity("coincidencia_sanciones", "boolean"),
        _identity("nivel_riesgo", enum=("bajo", "medio", "alto")),
    ),
    (
        DecisionRule("RK01", "(fecha_actual - fecha_nacimiento).days / 365.25 >= 18", "critica", "Mayoría de edad (>= 18)"),
        DecisionRule("RK02", "fecha_caducidad > fecha_actual", "critica", "Documento de identidad no caducado"),
        DecisionRule("RK03", "num_documento != 'No encontrado'", "advertencia", "Documento no marcado como 'No encontrado'"),
        DecisionRule("RK04", "fecha_expedicion == null or fecha_expedicion <= fecha_actual", "advertencia", "Fecha de expedición no futura cuando está informada"),
        DecisionRule("RK05", "coincidencia_sanciones == null or coincidencia_sanciones == false", "critica", "Sin coincidencia positiva en listas de sanciones"),
        DecisionRule("RK06", "pep != true or nivel_riesgo == null or nivel_riesgo in ['medio', 'alto']", "advertencia", "Si es PEP, el riesgo no debe quedar en nivel bajo"),
        DecisionRule("RK07", "titular_real_identificado == null or titular_real_identificado == true", "info", "Titular real identificado cuando el dato se informa"),
        DecisionRule("RK08", "proposito_relacion == null or proposito_relacion != ''", "info", "Propósito de la relación informado cuando está presente"),
    ),
    ("EXPEDIENTE_IDENTIDAD",),
)

SCHEMAS = {s.name: s for s in (MORTGAGE, INVOICE, IDENTITY)}
