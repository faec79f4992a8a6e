"""The corpus of case folders as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import corpus


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files = {
        "caso_uso_1_auditoria_hipotecaria/native_pdf/conforme": ["credito_native_conforme_001.pdf", "credito_native_conforme_001_ground_truth.json", "contrato_hipoteca_esp_0007.pdf", "alone.pdf"],
        "caso_uso_1_auditoria_hipotecaria/native_pdf/no_conforme": ["x_no_conforme_002.PDF", "x_no_conforme_002_ground_truth.json"],
        "caso_uso_1_auditoria_hipotecaria/deep/image_photo": ["foto_conforme_9.jpg", "foto_conforme_9_ground_truth.json", "other_12.pdf", "b_12_ground_truth.json", "a_12_ground_truth.json", "last_77.pdf", "GROUND_TRUTH_77.json"],
        "caso_uso_1_auditoria_hipotecaria": ["ground_truth_esp_0007.json", "outside.pdf"],
        "caso_uso_2_auditoria_fiscal/scanned_blurry_pdf/conforme": ["factura_fiscal_1.pdf", "factura_fiscal_1.json", "factura_fiscal_2.pdf", "z_2_ground_truth.json"],
        "caso_uso_3_kyc_onboarding/notes": ["expediente_kyc_1.pdf", "expediente_kyc_1.json"],
        "elsewhere/native_pdf": ["factura_fiscal_9.pdf", "factura_fiscal_9.json"],
    }
    for folder, names in files.items():
        os.makedirs(root / folder, exist_ok=True)
        for n in names:
            (root / folder / n).write_bytes(n.encode())
    return str(root)


def read(spark, root, **options):
    corpus.register(spark)
    return spark.read.format("case_corpus").options(**options).load(root)


def test_documents_with_their_truths(spark, root):
    got = {r.name: (r.schema_name, r.variant, r.compliance, os.path.basename(r.truth_path), bytes(r.content).decode()) for r in read(spark, root).collect()}
    h = "credito_hipotecario"
    assert got == {
        "credito_native_conforme_001.pdf": (h, "native_pdf", "conforme", "credito_native_conforme_001_ground_truth.json", "credito_native_conforme_001.pdf"),
        "contrato_hipoteca_esp_0007.pdf": (h, "native_pdf", "conforme", "ground_truth_esp_0007.json", "contrato_hipoteca_esp_0007.pdf"),
        "x_no_conforme_002.PDF": (h, "native_pdf", "no_conforme", "x_no_conforme_002_ground_truth.json", "x_no_conforme_002.PDF"),
        "foto_conforme_9.jpg": (h, "image_photo", None, "foto_conforme_9_ground_truth.json", "foto_conforme_9.jpg"),
        "other_12.pdf": (h, "image_photo", None, "a_12_ground_truth.json", "other_12.pdf"),
        "last_77.pdf": (h, "image_photo", None, "GROUND_TRUTH_77.json", "last_77.pdf"),
        "factura_fiscal_1.pdf": ("auditoria_fiscal", "scanned_blurry_pdf", "conforme", "factura_fiscal_1.json", "factura_fiscal_1.pdf"),
    }


def test_filters_reach_the_folders(spark, root):
    df = read(spark, root, content="false").where((F.col("variant") == "native_pdf") & F.col("compliance").isin("no_conforme") & F.col("name").endswith("PDF"))
    assert df.rdd.getNumPartitions() == 1  # one folder of six
    assert [(r.name, r.content) for r in df.collect()] == [("x_no_conforme_002.PDF", None)]
    assert read(spark, root).where("schema_name = 'auditoria_fiscal' and variant = 'image_photo'").collect() == []
    assert read(spark, root).where("compliance is null").count() == 3


def test_only_the_folders_asked_are_listed(root, monkeypatch):
    seen, scan = [], os.scandir
    monkeypatch.setattr(corpus.os, "scandir", lambda p: seen.append(os.path.relpath(p, root)) or scan(p))
    own = list(corpus.folders(root, {"schema_name": {"credito_hipotecario"}, "variant": {"native_pdf"}, "compliance": {"conforme"}}))
    assert [os.path.relpath(f.path, root) for f in own] == ["caso_uso_1_auditoria_hipotecaria/native_pdf/conforme"]
    assert not [p for p in seen if "image_photo" in p or "no_conforme" in p or "caso_uso_2" in p]


def test_a_corpus_of_nothing(spark, tmp_path):
    assert read(spark, str(tmp_path)).collect() == []
