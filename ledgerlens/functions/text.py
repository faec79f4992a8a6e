"""Text functions on Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any script, what (?U)\s matches. trim() by itself strips spaces alone.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Texts that stand for nothing, and what counts as a word.
NULL_TOKENS = ("null", "none", "no encontrado", "no encontrado.", "n/a", "na")
WORD_LIKE = r"[A-Za-z0-9ÁÉÍÓÚÜÑáéíóúüñ]{2,}"


def matches(text: Column, pattern: str) -> Column:
    """Number of matches. Counting the pieces of a split is far cheaper than regexp_count."""
    return F.size(F.split(text, pattern)) - 1


def strip(c: Column) -> Column:
    """Without white space at the ends; a look at the ends alone, so that long runs of spaces inside cost nothing more."""
    return F.trim(c, F.lit(SPACES))


def is_empty(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def for_compare(c: Column) -> Column:
    """Stripped, single-spaced, lower case, with ss for ß and one form of s and of sigma; the form in which texts are compared."""
    return F.replace(F.translate(F.lower(squeezed(c)), "ſς", "sσ"), F.lit("ß"), F.lit("ss"))


def texts_equal(a: Column, b: Column) -> Column:
    """Two nulls are equal, a null equals nothing else."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(for_compare(a) == for_compare(b))


def numbers_equal(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def values_equal(a: Column, b: Column, a_number: Column | None = None, b_number: Column | None = None, tolerance: float = 0.01) -> Column:
    """Numbers within the tolerance where both are numbers, texts by their compared form otherwise."""
    if a_number is None or b_number is None:
        return texts_equal(a, b)
    return F.when(a_number.isNotNull() & b_number.isNotNull(), F.abs(a_number - b_number) <= tolerance).otherwise(texts_equal(a, b))


def letters(c: Column) -> Column:
    """Whatever else there is goes run by run: a replacement a run, not a character."""
    return F.char_length(F.regexp_replace(c, r"\P{L}+", ""))


def digits(c: Column) -> Column:
    return F.char_length(F.regexp_replace(c, r"\P{Nd}+", ""))


def signs(c: Column) -> Column:
    """Neither letters nor numbers nor white space."""
    return F.char_length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]+", ""))


def signal_score(c: Column) -> Column:
    """1.6 letters + 0.7 digits + 7.5 words of two letters or more - 2 signs; white space counts nowhere."""
    t = F.coalesce(c, F.lit(""))
    return letters(t) * 1.6 + digits(t) * 0.7 + matches(t, WORD_LIKE) * 7.5 - signs(t) * 2.0


def signal_counts(texts: DataFrame, text: str) -> DataFrame:
    """Adds n_letters, n_digits, n_words and n_signs of a text column, each worked out once for all that is told from them."""
    t = texts.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    own = F.col("_t")
    return t.withColumns({"n_letters": letters(own), "n_digits": digits(own), "n_words": matches(own, WORD_LIKE), "n_signs": signs(own)}).drop("_t")


def signal_of_counts() -> tuple[Column, Column, Column]:
    """(score, meaningful, extractable) of the columns that signal_counts adds."""
    score = F.col("n_letters") * 1.6 + F.col("n_digits") * 0.7 + F.col("n_words") * 7.5 - F.col("n_signs") * 2.0
    return score, (F.col("n_words") >= 4) & (score >= 35.0), (F.col("n_words") >= 3) & (F.col("n_letters") + F.col("n_digits") >= 12)


def is_meaningful(c: Column, min_words: int = 4, min_score: float = 35.0) -> Column:
    """At least so many words and so much signal.

    A text has no more signs than characters that are no letters; where letters outweigh even those by more than
    rounding, as in any prose, nothing else is counted.
    """
    t = F.coalesce(c, F.lit(""))
    enough = F.size(F.split(t, WORD_LIKE, max(min_words, 0) + 1)) > min_words
    plenty = letters(t) * 3.6 - F.char_length(t) * 2.0 >= min_score + 1
    return t.rlike(r"(?U)\S") & enough & (plenty | (signal_score(t) >= min_score))


def has_extractable_signal(c: Column) -> Column:
    """At least 3 words and 12 letters or digits."""
    t = F.coalesce(c, F.lit(""))
    return (matches(t, WORD_LIKE) >= 3) & (letters(t) + digits(t) >= 12)


def candidate_score(c: Column, confidences: Column) -> Column:
    """Signal and 40 times the mean confidence of a reading."""
    mean = F.aggregate(F.coalesce(confidences, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(confidences), F.lit(1))
    return signal_score(c) + mean * 40.0


def better_text(a: Column, b: Column) -> Column:
    """The text of more signal, the first in a tie; an empty one loses."""
    x, y = strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))
    return F.when(x == "", y).when(y == "", x).when(signal_score(y) > signal_score(x), y).otherwise(x)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


# The keyword lists of the three kinds of case, in order of precedence.
KEYWORDS = {
    "kyc_onboarding": ("kyc", "onboarding", "pasaporte", "empadronamiento", "código postal", "codigo postal", "nacionalidad", "fecha de caducidad", "fecha caducidad", "fecha de expedicion", "justificante"),
    "auditoria_fiscal": ("factura", "modelo 303", "iva", "cuota", "base imponible", "cif"),
    "credito_hipotecario": ("hipoteca", "hipotecario", "irpf", "extracto bancario", "entidad financiera", "préstamo", "prestamo", "nota simple", "registro de la propiedad", "comparecen", "tasa de interes", "tasa_interes", "monto_prestamo"),
}
# Triggers in a text and hints in the name of a document type, in order.
TYPE_TRIGGERS = (
    (("escritura", "préstamo hipotecario", "prestamo hipotecario", "capital del préstamo", "capital del prestamo", "tipo de interés nominal", "tipo de interes nominal", "tin", "plazo de amortización", "plazo de amortizacion", "cláusula", "clausula"), ("escritura", "hipotec")),
    (("cirbe", "incidencias", "riesgos", "deuda vigente", "deuda_vigente"), ("cirbe",)),
    (("iban", "saldo", "transferencia", "movimiento", "extracto bancario"), ("extracto", "bancario")),
    (("factura", "iva", "base imponible", "cuota"), ("factura",)),
    (("irpf", "casilla", "declaración", "declaracion", "modelo 100"), ("irpf",)),
)


def classify(c: Column, keywords: dict | None = None, otherwise: str = "credito_hipotecario", fallback: Column | None = None) -> Column:
    """The first kind of which a keyword is anywhere in the lower-cased text; else the fallback's answer, else ``otherwise``."""
    t = F.lower(F.coalesce(c, F.lit("")))
    kinds = keywords or KEYWORDS
    out = None
    for kind, words in kinds.items():
        test = contains_any(t, words)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    last = F.lit(otherwise)
    return out.otherwise(last if fallback is None else F.coalesce(F.when(fallback.isin(*kinds), fallback), last))


def document_type(c: Column, document_types, triggers=TYPE_TRIGGERS) -> Column:
    """Of the first group of triggers that hits and has a type by its hints, that type; else null."""
    t = F.lower(F.coalesce(c, F.lit("")))
    tests = []
    for words, hints in triggers:
        own = next((d for d in document_types if any(h in d.lower() for h in hints)), None)
        if own is not None:
            tests.append(F.when(contains_any(t, words), F.lit(own)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


#: Word edges, white space and digits as Python's re has them for str: combining marks are no word characters, superscripts are.
_EDGE = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
_GAP = r"[\s\x1c-\x1f-]"
# What is redacted, in this order, each on the text that the ones before left.
PII = (
    ("email", rf"(?U){_EDGE}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{{2,}}{_EDGE}", "[EMAIL]"),
    ("iban", rf"(?U){_EDGE}[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}{_EDGE}", "[IBAN]"),
    ("dni", rf"(?U){_EDGE}\d{{8}}[A-Z]{_EDGE}", "[DNI]"),
    ("nie", rf"(?U){_EDGE}[XYZ]\d{{7}}[A-Z]{_EDGE}", "[NIE]"),
    ("nif_cif", rf"(?U){_EDGE}[A-Z]\d{{7}}[0-9A-Z]{_EDGE}", "[NIF_CIF]"),
    ("phone", rf"(?U){_EDGE}(?:\+?\d{{1,3}}{_GAP}?)?(?:\d{_GAP}?){{8,14}}{_EDGE}", "[PHONE]"),
)

#: A cheap pattern for each kind, without edges, that every text with a match of the kind holds as well. A redacted piece is
#: never part of a later match (no kind takes brackets, and a token has no digit and no @), so one look at the first text does.
ANCHORS = {
    "email": r"@[a-zA-Z0-9.-]+\.[A-Za-z]{2}", "iban": r"(?U)[A-Z]{2}\d{2}[A-Z0-9]{11}", "dni": r"(?U)\d{8}[A-Z]", "nie": r"(?U)[XYZ]\d{7}[A-Z]",
    "nif_cif": r"(?U)[A-Z]\d{7}[0-9A-Z]", "phone": rf"(?U)\d(?:{_GAP}?\d){{7}}",
}


def _redactions(kind: str, token: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("original"), F.lit(token).alias("replacement"))


def redact(c: Column) -> tuple[Column, Column]:
    """(redacted text, array<struct<kind, original, replacement>> in the order of redaction).

    The full patterns, slow for their edges, go over texts that hold the kind's anchor alone.
    """
    given = F.coalesce(c, F.lit(""))
    out, found = given, []
    for kind, pattern, token in PII:
        there = given.rlike(ANCHORS[kind])
        all_of = F.transform(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)), _redactions(kind, token))
        found.append(F.when(there, all_of).otherwise(F.array().cast("array<struct<kind:string,original:string,replacement:string>>")))
        out = F.when(there, F.regexp_replace(out, pattern, token)).otherwise(out)
    return out, F.concat(*found)


def chunks(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<string>: pieces of ``size`` characters, each begun ``overlap`` before the last one's end, stripped, none empty."""
    t = strip(F.coalesce(c, F.lit("")))
    if size <= 0:
        return F.filter(F.array(t), lambda x: x != "")
    if overlap >= size:
        overlap = max(0, size // 4)
    step = size - overlap
    last = F.greatest(F.ceil((F.char_length(t) - size) / F.lit(step)), F.lit(0)).cast("int")
    # the text is cut once into pieces of a step; each chunk is the piece and the beginning of what follows
    cut = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    whole = lambda a, i: F.substring(F.array_join(F.slice(a, i + 1, F.lit(-(-size // step))), ""), 1, size)
    pieces = F.get(F.transform(F.array(cut), lambda a: F.transform(F.sequence(F.lit(0), last), lambda i: strip(whole(a, i)))), F.lit(0))
    return F.filter(pieces, lambda x: x != "")


def chunk_rows(c: Column, page: Column | None = None) -> Column:
    """array<struct<id, text, page>>: pieces numbered after empty ones are dropped, p{page}_c{n} or c{n}."""
    head = F.lit("c") if page is None else F.concat(F.lit("p"), page.cast("string"), F.lit("_c"))
    number = page.cast("int") if page is not None else F.lit(None).cast("int")
    return F.transform(chunks(c), lambda x, i: F.struct(F.concat(head, (i + 1).cast("string")).alias("id"), x.alias("text"), number.alias("page")))


def identifier(c: Column) -> Column:
    """Letters, digits, _ and - of the lower-cased name, 48 at most, begun with d_; `doc` if nothing is left."""
    own = F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_-]", ""), 1, 48)
    return F.concat(F.lit("d_"), F.when(own == "", "doc").otherwise(own))


def pattern_value(text: Column, pattern: str) -> Column:
    """What a field's pattern finds: of an anchored one the first token it matches whole, else group 1 or the match, in any case."""
    if pattern.startswith("^") and pattern.endswith("$"):
        inner = pattern[1:-1]
        return F.get(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: t.rlike(rf"\A(?:{inner})\z")), F.lit(0))
    import re

    group = 1 if re.compile(pattern).groups else 0
    whole = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group))
    return F.get(whole, F.lit(0))


def evidence_page(evidence: Column, pages: Column) -> Column:
    """Number of the first page that holds the evidence; 1 if none does."""
    at = F.array_position(F.transform(pages, lambda p: F.contains(p, evidence)), True)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(1).cast("int")


def money_es(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


# What a file's name says of its kind, in order; and of which schema a folder is.
NAME_KINDS = ("scanned_blurry_pdf", "native_pdf", "image_photo", "image_handwritten")
IMAGE_ENDS = (".jpg", ".jpeg", ".png", ".webp")
FOLDERS = {"caso_uso_1_auditoria_hipotecaria": "credito_hipotecario", "caso_uso_2_auditoria_fiscal": "auditoria_fiscal", "caso_uso_3_kyc_onboarding": "kyc_onboarding"}


def kind_of_name(name: Column) -> Column:
    """The kind of document that a file name tells of: a named kind, else image or pdf by its end, else unknown."""
    n = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for kind in NAME_KINDS:
        out = F.when(F.contains(n, F.lit(kind)), kind) if out is None else out.when(F.contains(n, F.lit(kind)), kind)
    ends = reduce(lambda a, b: a | b, [n.endswith(e) for e in IMAGE_ENDS])
    return out.when(ends, "image").when(n.endswith(".pdf"), "pdf").otherwise("unknown")


def schema_of_path(path: Column, folders: dict[str, str] = FOLDERS) -> Column:
    """The schema of the first folder of a path that has one; null if none has."""
    of = lambda part: F.coalesce(*[F.when(F.contains(part, F.lit(k)), v) for k, v in folders.items()])
    return F.get(F.filter(F.transform(F.split(path, "/"), of), lambda x: x.isNotNull()), F.lit(0))


def first_of(values: Column, *keys: str) -> Column:
    """What a map has at the first of the keys where it is not empty; else ''."""
    return F.coalesce(*[F.nullif(values[k], F.lit("")) for k in keys], F.lit(""))
