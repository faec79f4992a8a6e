"""Schemas: typed fields with constraints, and decision rules. Loaded from YAML or built in code."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any

TYPES = {
    "float": "number", "number": "number", "decimal": "number", "int": "integer", "integer": "integer",
    "bool": "boolean", "boolean": "boolean", "date": "date", "fecha": "date", "datetime": "datetime", "timestamp": "datetime",
}
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")


@dataclass(frozen=True)
class Constraint:
    """kind: min, max, regex, enum or format (kept, never enforced)."""

    kind: str
    value: Any


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    document_type: str | None = None
    constraints: tuple[Constraint, ...] = ()
    label: str = ""

    def values(self, kind: str) -> list:
        return [c.value for c in self.constraints if c.kind == kind]


@dataclass(frozen=True)
class DecisionRule:
    id: str
    expression: str
    severity: str = "advertencia"
    description: str = ""
    norm: str = ""

    @property
    def key(self) -> str:
        return self.id.strip() or self.expression.strip() or self.description.strip()


@dataclass(frozen=True)
class Schema:
    name: str
    version: str = "1.0"
    fields: tuple[Field, ...] = ()
    rules: tuple[DecisionRule, ...] = ()
    document_types: tuple[str, ...] = ()
    domain: str = ""

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def for_document_type(self, document_type: str | None) -> Schema:
        """The schema with the fields of one document type, unless that leaves none."""
        own = tuple(f for f in self.fields if f.document_type == document_type)
        return replace(self, fields=own) if document_type and own else self

    def for_present_types(self, present: list[str]) -> Schema:
        own = tuple(f for f in self.fields if f.document_type is None or f.document_type in present)
        return replace(self, fields=own) if present and own else self


def type_of(name: Any) -> str:
    return TYPES.get(str(name or "").strip().lower(), "string")


def _constraints(raw: dict) -> tuple[Constraint, ...]:
    found = []
    checks = raw.get("validacion") or {}
    if raw.get("patron"):
        found.append(Constraint("regex", str(raw["patron"])))
    for source in (raw, checks):
        for key, kind in (("rango_min", "min"), ("rango_max", "max")):
            if source.get(key) is not None:
                found.append(Constraint(kind, float(source[key])))
        if source.get("valores_permitidos"):
            found.append(Constraint("enum", tuple(source["valores_permitidos"])))
    if raw.get("formato"):
        found.append(Constraint("format", str(raw["formato"])))
    return tuple(found)


def _simple_field(raw: dict) -> Field:
    own = []
    for rule in raw.get("rules") or []:
        params = rule.get("params") or {}
        value = params.get("value", params.get("pattern", params.get("values")))
        own.append(Constraint(rule["kind"], tuple(value) if isinstance(value, list) else value))
    return Field(raw["name"], raw.get("type", "string"), bool(raw.get("required")), raw.get("document_type"), tuple(own), raw.get("description") or "")


def schema_from(raw: dict) -> Schema:
    """A schema of either dialect: {name, version, fields} or {caso_uso, documentos, reglas_decision}."""
    if "caso_uso" not in raw:
        rules = tuple(DecisionRule(str(r.get("id") or ""), r["expression"], r.get("severity", "advertencia"), r.get("description") or "") for r in raw.get("rules") or [])
        return Schema(raw["name"], str(raw.get("version", "1.0")), tuple(map(_simple_field, raw.get("fields") or [])), rules, tuple(raw.get("document_types") or ()))
    fields, kinds = [], []
    for document in raw.get("documentos") or []:
        kinds.append(document["tipo"])
        for c in document.get("campos") or []:
            fields.append(Field(c["nombre"], type_of(c.get("tipo_dato")), bool(c.get("requerido")), document["tipo"], _constraints(c), c.get("etiqueta") or ""))
    rules = tuple(
        DecisionRule(str(r.get("id") or ""), r["expresion"], r.get("severidad") or "advertencia", r.get("descripcion") or "", r.get("normativa") or "")
        for r in raw.get("reglas_decision") or []
    )
    return Schema(raw["caso_uso"], str(raw.get("version", "1.0")), tuple(fields), rules, tuple(kinds), raw.get("dominio") or "")


def load_schema(path: str | Path) -> Schema:
    """Reads a YAML schema in the first encoding that fits."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML schemas needs PyYAML; schema_from() takes a parsed dict") from e
    data = Path(path).read_bytes()
    for encoding in ENCODINGS:
        try:
            return schema_from(yaml.safe_load(data.decode(encoding)))
        except (UnicodeDecodeError, yaml.reader.ReaderError):
            continue
    raise ValueError(f"{path}: in none of {ENCODINGS}")


def schema_tables(spark, schemas: list[Schema]):
    """(fields, rules) as two small dimension tables."""
    fields = [(s.name, f.name, i, f.type, f.required, f.document_type, [(c.kind, str(c.value)) for c in f.constraints]) for s in schemas for i, f in enumerate(s.fields)]
    rules = [(s.name, i, r.id, r.expression, r.severity, r.description) for s in schemas for i, r in enumerate(s.rules)]
    return (
        spark.createDataFrame(fields, "schema string, field string, ordinal int, type string, required boolean, document_type string, constraints array<struct<kind:string,value:string>>"),
        spark.createDataFrame(rules, "schema string, ordinal int, rule_id string, expression string, severity string, description string"),
    )


def infer_schema(name: str, example: dict) -> Schema:
    """A schema from one parsed record."""

    def guess(v: Any) -> str:
        if isinstance(v, bool):
            return "boolean"
        if isinstance(v, int):
            return "integer"
        if isinstance(v, float):
            return "number"
        s = str(v or "")
        return "date" if len(s) == 10 and s[4:5] == "-" and s[7:8] == "-" else "string"

    return Schema(name, "1.0", tuple(Field(k, guess(v)) for k, v in example.items()))


__all__ = ["Constraint", "DecisionRule", "Field", "Schema", "infer_schema", "load_schema", "schema_from", "schema_tables", "type_of"]


# What a model is told of the form of its answer, before and after the fields.
ANSWER_FORM = (
    "Devuelve SOLO JSON válido (RFC 8259).",
    "Usa comillas dobles para claves y strings. No uses comas finales ni comentarios.",
    "No incluyas comentarios (// o /* */) ni texto fuera del JSON.",
    "Para números: NO uses separadores de miles (ni '.' ni ','). Usa '.' solo como separador decimal.",
    "Si el número aparece en formato local (ej: 5.489,11), envíalo como string.",
    "Devuelve un ÚNICO objeto JSON (dict) con claves=nombre_del_campo y valores=valor_extraído.",
    'Formato: { "campo_1": valor, "campo_2": valor, ... }',
    "Los nombres de las claves deben coincidir exactamente con estos campos:",
)
ANSWER_END = "Si no encuentras un valor, usa null."


def instructions(schema: Schema) -> str:
    """What a model is told to give: the form of the answer and the schema's fields, with the values that an enum allows."""
    told = []
    for f in schema.fields:
        allowed = next(iter(f.values("enum")), None)
        plain = isinstance(allowed, (list, tuple)) and allowed and all(isinstance(x, (str, int, float, bool)) for x in allowed)
        told.append(f'- "{f.name}" ({f.type}) requerido={f.required}' + (f" valores_permitidos={[str(x) for x in allowed]}" if plain else ""))
    return "\n".join([*ANSWER_FORM, *told, ANSWER_END])
