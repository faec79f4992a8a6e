import datetime
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens import queries
from ledgerlens.functions import dates, numbers, ocr, repair, text


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


NUMBERS = {
    "2.445,37 EUR": 2445.37, "4,160,00": 4160.0, "5,603,25": 5603.25, "1,250.50": 1250.5, "9000": 9000.0, "2.445": 2.445, "1,250": 1.25,
    "12.345,678": 12345678.0, "1.250.500": 1250500.0, "7E2.60 EUR": 762.6, "3,.590,00": 3590.0, "-12,5": -12.5, "abc": None, "": None, "€ 1 000,5": 1000.5, "5,": None,
}


def test_parse_number(spark):
    assert values(spark, list(NUMBERS), numbers.parse_number) == list(NUMBERS.values())


def test_parse_date(spark):
    cases = {"25/03/2026": "2026-03-25", "2026-03-25": "2026-03-25", "20260325": "2026-03-25", "1-2-2024": "2024-02-01", "31/02/2024": None, "2026": None, "": None}
    assert values(spark, list(cases), lambda c: dates.parse_date(c).cast("string")) == list(cases.values())


def test_flags(spark):
    assert values(spark, ["Sí", "0", "quizás", " TRUE "], dates.parse_flag) == [True, False, None, True]


def test_ocr_numbers(spark):
    assert values(spark, ["70884", "Comision: 7O8.84 EUR"], ocr.compact_money) == [708.84, 708.84]
    assert values(spark, ["TAE: 5.A9"], ocr.decimal_like) == [5.49]
    assert values(spark, ["Tasa 591%", "TIN: L51%", "x", "3L9 %"], ocr.percent) == [5.91, 6.51, None, 3.19]
    assert values(spark, ["DNI: 864732I2N", "Nombre: 86473212N", "DANE: 864732125"], ocr.labelled_id) == ["86473212N", None, "86473212S"]


def test_text_functions(spark):
    assert values(spark, ["  a b \n"], text.for_compare) == ["a b"]
    assert values(spark, ["hola mundo 12"], text.signal_score) == [pytest.approx(9 * 1.6 + 2 * 0.7 + 3 * 7.5)]
    assert values(spark, ["Mi Colección!", None], text.identifier) == ["d_micoleccin", "d_doc"]
    assert values(spark, ["factura 1", "pasaporte e iva", "nada"], lambda c: text.classify(c)) == ["auditoria_fiscal", "kyc_onboarding", "credito_hipotecario"]


def test_signal_counts_by_character(spark):
    """Every character of the first planes: what counts is what single replacements of squeezed texts left."""
    signs = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(signs[i : i + 64]) for i in range(0, len(signs), 64)] + [f"{c}a {c}{c} b{c}" for c in signs if c.isspace() or c in "\u180e\u200b\ufeff"] + ["", None, " \u3000\n"]
    left = lambda pattern: lambda c: F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " "), pattern, ""))
    for own, pattern in ((text.letters, r"\P{L}"), (text.digits, r"\P{Nd}"), (text.signs, r"(?U)[\p{L}\p{N}\s]")):
        assert values(spark, rows, lambda c, own=own: own(F.coalesce(c, F.lit("")))) == values(spark, rows, left(pattern))
    assert values(spark, rows, text.strip) == values(spark, rows, lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""))


def test_meaningful_near_its_bounds(spark):
    draw = random.Random(5)
    rows = ["".join(draw.choices("abñ7. \u3000%漢²", (9, 9, 3, 2, 1, 6, 1, draw.randrange(12), 1, 1), k=draw.randrange(1, 70))) for _ in range(4000)] + ["", " \u3000 ", None]
    words = [len(re.findall(text.WORD_LIKE, r or "")) for r in rows]
    scores = values(spark, rows, text.signal_score)
    for least, score in ((4, 35.0), (1, -50.0), (0, 0.0)):
        want = [(r or "").strip() != "" and w >= least and s >= score for r, w, s in zip(rows, words, scores, strict=True)]
        assert 0 < sum(want) < len(rows)
        assert values(spark, rows, lambda c, a=least, b=score: text.is_meaningful(c, a, b)) == want


def test_long_runs_of_spaces_are_gone_through_once(spark):
    rows = ["cuatro palabras hay aqui seguro" + " " * 400_000 + "fin "]
    start = time.perf_counter()
    assert values(spark, rows, text.strip) == [rows[0][:-1]] and values(spark, rows, text.is_meaningful) == [True]
    assert time.perf_counter() - start < 20


def test_chunks_reassemble(spark):
    t = "".join(chr(97 + i % 26) for i in range(3001))
    got = values(spark, [t, "", "short"], text.chunks)
    assert [len(c) for c in got[0]] == [1200, 1200, 1001] and got[1] == [] and got[2] == ["short"]
    assert got[0][0] + "".join(c[200:] for c in got[0][1:]) == t


def test_redaction_order(spark):
    out = values(spark, ["mail a@b.es dni 12345678Z tel 600 123 456"], lambda c: text.redact(c)[0])
    assert out == ["mail [EMAIL] dni [DNI] tel [PHONE]"]
    log = values(spark, ["a@b.es 12345678Z"], lambda c: text.redact(c)[1])[0]
    assert [(r.kind, r.original) for r in log] == [("email", "a@b.es"), ("dni", "12345678Z")]


PII = (
    ("email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]"), ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"), ("dni", r"\b\d{8}[A-Z]\b", "[DNI]"),
    ("nie", r"\b[XYZ]\d{7}[A-Z]\b", "[NIE]"), ("nif_cif", r"\b[A-Z]\d{7}[0-9A-Z]\b", "[NIF_CIF]"), ("phone", r"\b(?:\+?\d{1,3}[\s-]?)?(?:\d[\s-]?){8,14}\b", "[PHONE]"),
)
ODD = ["x a@b.es² y", "12345678Ź end", "é12345678Z 12345678Zé", "́a@b.es", "tel 600\x1c123\x1d456", "tel ٦٠٠ ١٢٣ ٤٥٦", "a@b.es‿", "ES9121000418450200051332Ⅰ", None, ""]


def test_redaction_of_documents_equals_brute_force(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-1 - i, x) for i, x in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.redact_pii_counts(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        out, counts = x or "", {}
        for kind, pattern, token in PII:
            out, counts[f"n_{kind}"] = re.subn(pattern, token, out)
        assert got[i].asDict() == {"doc_id": i, "redacted_sha256": hashlib.sha256(out.encode()).hexdigest(), **counts}, (i, out[:200])


def test_anchors_hold_where_tokens_stand(spark):
    """What an earlier kind has cut out neither makes nor hides a later match; long texts take linear work."""
    own = ["a@b.es12345678Z", "12345678Z600123456", "ES9121000418450200051332 X1234567L A1234567B +34 600-123-456 x@y.zz", "600 123 45", "@", "1 2 3 4 5 6 7 8"]
    own.append("x@y.zz 12345678Z " * 5_000)
    for x, got in zip(own, values(spark, own, lambda c: F.struct(*text.redact(c))), strict=True):
        out, said = x, []
        for kind, pattern, token in PII:
            said += [(kind, m.group(), token) for m in re.finditer(pattern, out)]
            out = re.sub(pattern, token, out)
        assert got[0] == out and [tuple(r) for r in got[1]] == said


def test_iso_datetimes_equal_python(spark):
    own = ["2024-01-02", "2024-01-02T03", "2024-01-02T03:04", " 2024-01-02 03:04:05 ", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02T03:04:05,1234567-0530", "2024-01-02T03:04:05.000",
           "2024-01-02T25:04:05", "2024-02-30", "2024-01-02T03:04+24:00", "2024-01-02T03:04-00:00", "2024-01-02T03:04.5", "2024-01-02T03:60:05", "2024-01-02T03:04:05.", "2024-01-02T24:00:00", "2024-01-02Z", "0001-01-01", "x", "", None]

    def python(x):
        try:
            return datetime.datetime.fromisoformat(x.strip()).isoformat()
        except (AttributeError, ValueError):
            return None

    assert values(spark, own, dates.iso_datetime) == [python(x) for x in own]


def test_grouped_digits_are_numbers(spark):
    assert values(spark, ["1_000", "1__0", "_1", "1_", "1_0.5_0e1_0", "5d", " 7 ", None], numbers.strict_number) == [1000.0, None, None, None, 10.5e10, None, 7.0, None]


def test_pattern_values(spark):
    p = "^[XYZ0-9][0-9]{7}[A-Z]$"
    assert values(spark, ["Documento: 53864817D.", "none"], lambda c: text.pattern_value(c, p)) == ["53864817D", None]


def test_p95_exclusive(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 11)],), ([1.0, 2.0],), ([7.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(numbers.p95_exclusive(F.col("x"))).collect()] == pytest.approx([10.45, 2.85, 7.0, 0.0])


def test_loan_round_trip(spark):
    df = spark.sql("SELECT 157520.0D AS p, 3.6D AS r, 252.0D AS n")
    pay = numbers.monthly_payment(F.col("p"), F.col("r"), F.col("n"))
    assert df.select(numbers.principal_of(pay, F.col("r"), F.col("n"))).first()[0] == pytest.approx(157520.0)


JSON = {
    '{"a": 5.489.11}': {"a": 5489.11},
    '```json\n{"a": 1, // note\n "b": [1, 2,],}\n```': {"a": 1, "b": [1, 2]},
    "{'a': True, 'b': None}": {"a": True, "b": None},
    'text before {"n": 1.234,56} after': {"n": 1234.56},
    '{"u": "http://x//y"}': {"u": "http://x//y"},
}


def test_tolerant_json(spark):
    for raw, want in JSON.items():
        assert repair.read_json(raw) == want
    with pytest.raises(ValueError):
        repair.read_json("nothing")
    got = values(spark, ['{"a":1}', "{'a': 1,}", "nope"], repair.parsed_json)
    assert got == ['{"a":1}', '{"a": 1}', None]


def test_degradation_repeats():
    t = "Precio 1.234,56 € – Oficina " * 40
    assert repair.degrade_text(t, 7) == repair.degrade_text(t, 7)
    assert len({repair.degrade_text(t, s) for s in range(8)}) > 1


def test_mixed_strokes_and_folded_letters(spark):
    assert values(spark, ["25/03-2026", "1-2/2026", "31/02-2026", None], lambda c: dates.parse_date(c).cast("string")) == ["2026-03-25", "2026-02-01", None, None]
    assert values(spark, ["Straße", "ſo ΟΔΟΣ", "οδος"], text.for_compare) == ["strasse", "so οδοσ", "οδοσ"]
