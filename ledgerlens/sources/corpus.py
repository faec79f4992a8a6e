"""A corpus of case folders as a data source: ``spark.read.format("case_corpus").load(path)``.

Folders are case / ... / variant / compliance. Every folder that holds documents is a partition: planning walks folders alone, and filters on
case, schema, variant and compliance keep it out of those that nobody asked for. Documents are listed, paired with their truth and read by the tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# The case folders with their schemas, the variants, the compliance folders and the documents' suffixes.
CASES = {"caso_uso_1_auditoria_hipotecaria": "credito_hipotecario", "caso_uso_2_auditoria_fiscal": "auditoria_fiscal", "caso_uso_3_kyc_onboarding": "kyc_onboarding"}
VARIANTS = ("native_pdf", "scanned_blurry_pdf", "image_photo", "image_handwritten")
COMPLIANCE = ("conforme", "no_conforme")
SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png")

SCHEMA = "case_id string, schema_name string, variant string, compliance string, name string, path string, truth_path string, content binary"
PUSHED = ("case_id", "schema_name", "variant", "compliance")


@dataclass
class Folder(InputPartition):
    """A folder of documents, its case's folder, and what its path says."""

    path: str
    case_path: str
    case_id: str
    variant: str
    compliance: str | None

    @property
    def schema_name(self) -> str:
        return CASES[self.case_id]


def folders(root: str, asked: dict[str, set]) -> Iterator[Folder]:
    """The folders below a variant's folder; asked: for a column the values that are wanted, all if it is missing."""
    wanted = lambda column, value: column not in asked or value in asked[column]
    for case_id, schema_name in CASES.items():
        case_path = os.path.join(root, case_id)
        if wanted("case_id", case_id) and wanted("schema_name", schema_name) and os.path.isdir(case_path):
            yield from _below(case_path, Folder(case_path, case_path, case_id, "", None), wanted)


def _below(path: str, seen: Folder, wanted) -> Iterator[Folder]:
    if seen.variant and wanted("compliance", seen.compliance):
        yield Folder(path, seen.case_path, seen.case_id, seen.variant, seen.compliance)
    with os.scandir(path) as entries:
        names = sorted(e.name for e in entries if e.is_dir())
    for name in names:
        variant, compliance = seen.variant, seen.compliance
        if not variant and name in VARIANTS:
            if not wanted("variant", name):
                continue
            variant = name
        elif variant and compliance is None and name in COMPLIANCE:
            if not wanted("compliance", name):
                continue
            compliance = name
        yield from _below(os.path.join(path, name), Folder(path, seen.case_path, seen.case_id, variant, compliance), wanted)


def truth_patterns(name: str) -> list[str]:
    """Names of truths of a document, as patterns, the best first. Names of the three generated kinds have one name each."""
    stem = re.escape(os.path.splitext(name)[0])
    low = name.lower()
    own = [rf"{stem}_ground_truth\.json"] if "_conforme_" in low else []
    if low.endswith(".pdf"):
        if low.startswith("contrato_hipoteca_esp_"):
            return [*own, rf"ground_truth_esp_{re.escape(low[:-4].split('_')[-1])}\.json"]
        if low.startswith(("factura_fiscal_", "expediente_kyc_")):
            return [*own, rf"{stem}\.json"]
        if number := re.search(r"(\d+)\.pdf\Z", low):
            return [*own, rf".*_{number[1]}_ground_truth\.json", rf"(?=.*(?i:ground_truth)).*{number[1]}\.json"]
    return own


def truth_of(name: str, lists: list[tuple[str, list[str]]]) -> str | None:
    """The path of a document's truth: in the first of the (folder, sorted names) that has one, by its best name."""
    for folder, names in lists:
        for pattern in truth_patterns(name):
            for n in names:
                if re.fullmatch(pattern, n):
                    return os.path.join(folder, n)
    return None


class CorpusReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content, self.asked = root, content, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked[column] = self.asked[column] & values if column in self.asked else values
            else:
                yield f

    def partitions(self):
        return list(folders(self.root, self.asked))

    def read(self, folder: Folder | None):
        if folder is None:  # where there are no folders
            return
        lists = [(p, sorted(n for n in os.listdir(p) if n.endswith(".json"))) for p in dict.fromkeys((folder.path, folder.case_path))]
        with os.scandir(folder.path) as entries:
            found = sorted(e.name for e in entries if e.is_file() and os.path.splitext(e.name)[1].lower() in SUFFIXES)
        for name in found:
            truth = truth_of(name, lists)
            if truth:
                path, content = os.path.join(folder.path, name), None
                if self.content:
                    with open(path, "rb") as f:
                        content = f.read()
                yield folder.case_id, folder.schema_name, folder.variant, folder.compliance, name, path, truth, content


class CorpusSource(DataSource):
    """Options: path, a folder that driver and executors see alike; content, `false` to leave the bytes unread."""

    @classmethod
    def name(cls) -> str:
        return "case_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options["path"], str(self.options.get("content", "true")).lower() != "false")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
