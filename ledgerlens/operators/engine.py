"""The whole way from texts to audited records, by document and by case file."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators.audit import audit
from ledgerlens.operators.extract import extract
from ledgerlens.operators.merge import fill_missing, fold_fields, lengthen, present_types, widen
from ledgerlens.plans.builtin import SCHEMAS
from ledgerlens.plans.schema import Schema
from ledgerlens.sources.tables import written

RESULT = ("document_type", "schema_name", "n_prefilled", "valid", "score", "status", "state", "issues", "changes", "autocorrections", "rules", "report", "extracted")

CASE_RESULT = ("types", "valid", "score", "status", "state", "issues", "changes", "autocorrections", "rules", "report")


def audit_texts(docs: DataFrame, schemas: dict[str, Schema] | None = None, *, keys: list[str], text_col: str = "text", redact: bool = False, as_of: datetime.date | None = None, provider=None) -> DataFrame:
    """keys and the audit of each text: classified, extracted by its schema, normalized, validated, audited.

    extracted holds the raw fields as JSON, as their names differ by schema. Texts are read, redacted and classified
    once, and each schema's fields extracted once from its own documents: both are tables in the shared folder.
    """
    schemas = schemas or SCHEMAS
    base = docs.select(*keys, (text.redact(F.col(text_col))[0] if redact else F.col(text_col)).alias("text"))
    base = written(base.withColumn("schema_name", text.classify(F.col("text"))), "classified")
    out = None
    for name, schema in schemas.items():
        own = base.where(F.col("schema_name") == name).withColumn("document_type", text.document_type(F.col("text"), schema.document_types))
        raw = extract(own, schema, provider=provider)
        fields = [f.name for f in schema.fields]
        raw = written(raw.withColumn("extracted", F.to_json(F.struct(*fields))), "extracted")
        part = audit(raw, schema, as_of=as_of, details="details").select(*keys, *RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def audit_cases(docs: DataFrame, schema: Schema, *, case: str = "case_id", order: str = "doc_index", text_col: str = "text", name_col: str | None = None, as_of: datetime.date | None = None, provider=None) -> DataFrame:
    """One audited record a case file: its documents' raw fields merged by confidence, then normalized, validated and audited.

    A case is held to the fields of the document types it has, and its score counts the merged fields' confidences.
    """
    typed = docs.withColumn("document_type", text.document_type(F.col(text_col), schema.document_types))
    found = written(extract(typed, schema, text_col=text_col, name_col=name_col, provider=provider), "extracted")
    rows = lengthen(found.withColumnRenamed("details", "_details"), schema, [case, order, "_details"])
    detail = F.col("_details")[F.col("field")]
    rows = rows.select(case, order, "field", "value", detail["confidence"].alias("confidence"), detail.isNotNull().alias("has_detail"))
    merged = fill_missing(fold_fields(rows, case, order), schema, case)
    details = merged.where("value is not null and confidence is not null").groupBy(F.col(case).alias("_case")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("confidence")))).alias("details")
    )
    types = present_types(found, case, order).withColumnRenamed(case, "_typed")
    wide = widen(merged, schema, case)
    wide = wide.join(details, wide[case].eqNullSafe(details["_case"]), "left").join(types, wide[case].eqNullSafe(types["_typed"]), "left").drop("_case", "_typed")
    wide = wide.withColumns({"types": F.coalesce("types", F.array().cast("array<string>")), "details": F.coalesce("details", F.create_map().cast("map<string,struct<confidence:double>>"))})
    return audit(written(wide, "merged"), schema, as_of=as_of, details="details", present="types")


# Words anywhere in a case that make it a mortgage, before any other kind is looked at.
MORTGAGE_SIGNALS = ("hipoteca", "hipotecario", "irpf", "modelo 100", "cirbe", "incidencias", "nota simple", "registro de la propiedad", "préstamo", "prestamo")


def case_kind(docs: DataFrame, case: str = "case_id", text_col: str = "text", first: tuple[str, tuple[str, ...]] = ("credito_hipotecario", MORTGAGE_SIGNALS), kinds: dict | None = None, otherwise: str = "credito_hipotecario") -> DataFrame:
    """(case, schema_name): the kind of a case file, told from all its documents together.

    A case with one of the ``first`` kind's signals is of that kind; otherwise the first of ``kinds`` with a keyword counts, as for one
    text. Texts that are null or blank say nothing; a case of nothing but those is ``otherwise``. Every word is looked for in the documents
    and the finds are gathered, not the texts: a keyword that a document's end and the next one's beginning make together, which needs
    the line feed between them, is none of the lists'.
    """
    kinds = kinds or text.KEYWORDS
    t = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    told = [(first[0], first[1]), *kinds.items()]
    finds = docs.groupBy(case).agg(*[F.max(text.contains_any(t, words)).alias(f"_{i}") for i, (_, words) in enumerate(told)])
    kind = F.coalesce(*[F.when(F.col(f"_{i}"), name) for i, (name, _) in enumerate(told)], F.lit(otherwise))
    return finds.select(case, kind.alias("schema_name"))


def audit_case_files(docs: DataFrame, schemas: dict[str, Schema] | None = None, *, case: str = "case_id", order: str = "doc_index", text_col: str = "text", name_col: str | None = None, as_of: datetime.date | None = None, provider=None) -> DataFrame:
    """case, schema_name and the audit of each case file, held to the schema of its kind. Cases of a kind without a schema are left out."""
    schemas = schemas or SCHEMAS
    kinds = case_kind(docs, case, text_col).withColumnRenamed(case, "_case")
    told = written(docs.join(kinds, docs[case].eqNullSafe(kinds["_case"])).drop("_case"), "kinds")
    out = None
    for name, schema in schemas.items():
        own = audit_cases(told.where(F.col("schema_name") == name).drop("schema_name"), schema, case=case, order=order, text_col=text_col, name_col=name_col, as_of=as_of, provider=provider)
        part = own.select(case, F.lit(name).alias("schema_name"), *CASE_RESULT)
        out = part if out is None else out.unionByName(part)
    return out
