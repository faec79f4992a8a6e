"""Numbers and ids as OCR leaves them, read on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.numbers import parse_number
from ledgerlens.functions.text import strip

# Letters that stand for digits in each reading.
IN_NUMBER = ("OoQqIiLlZzSsBbRrAaEe", "00001111225588884466")
IN_MONEY = ("OQGILZRSBE", "0001128886")
IN_PERCENT = ("OQILZASBRE", "0011245886")
IN_ID = ("OQILZ", "00112")
ID_TAIL = ("58012", "SBOIZ")
ID_LABELS = "DNI|DNE|DANE|DNNE|DOCUMENTO"


def _after_colon(c: Column) -> Column:
    """What stands behind the first colon, or all."""
    return F.when(F.contains(c, F.lit(":")), F.regexp_replace(c, r"(?s)\A[^:]*:", "")).otherwise(c)


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def number(c: Column) -> Column:
    """A number with text before it, letters for digits in it, and letters after it."""
    s = F.regexp_replace(strip(c), r"(?U)\s+", "")
    s = F.regexp_replace(s, r"\A[^0-9+\-]+(?=[0-9])", "")
    for digit in "0124568":
        letters = "".join(a for a, b in zip(*IN_NUMBER, strict=True) if b == digit)
        if letters:
            s = F.regexp_replace(s, rf"(?<=[0-9])[{letters}](?=[0-9,.+-])", digit)
    return parse_number(F.regexp_replace(s, r"(?<=[0-9])[A-Za-z]+\z", ""))


def compact_money(c: Column) -> Column:
    """An amount whose separators are lost: its digits as cents; of fewer than three, null."""
    s = F.regexp_replace(F.upper(_after_colon(c)), r"(?U)\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"EUR\z", ""), "[^0-9A-Z]", "")
    s = F.when(s.rlike(r"[0-9].*[ES]\z"), F.regexp_replace(s, r"[ES]\z", "8")).otherwise(s)
    d = _only_digits(F.translate(s, *IN_MONEY))
    return F.when(F.char_length(d) >= 3, F.round(d.try_cast("double") / 100.0, 2))


def percent(c: Column) -> Column:
    """A rate of the form d.dd whose point is lost, in the last chunk that has a digit or looks like one."""
    s = F.upper(F.coalesce(c, F.lit("")))
    chunk = F.when(s.rlike("[0-9]"), F.try_element_at(F.filter(F.regexp_extract_all(s, F.lit("[0-9A-Z]+"), F.lit(0)), lambda x: x.rlike("[0-9LAES]")), F.lit(-1)))
    plain = F.translate(chunk, *IN_PERCENT)
    d = _only_digits(plain)
    d = F.when(chunk.rlike(r"\A[LI]") & (F.char_length(d) >= 3), F.concat(F.lit("6"), F.substring(d, 2, 99))).otherwise(d)
    first = F.substring(d, 1, 1)
    long_ = F.concat(first, F.lit("."), F.substring(d, 2, 2)).try_cast("double")
    short = F.concat(first, F.lit("."), F.substring(d, 2, 1)).try_cast("double")
    return F.when(F.char_length(d) >= 3, long_).when(F.char_length(d) == 2, short).otherwise(parse_number(plain))


def decimal_like(c: Column) -> Column:
    """d or dd, a separator, and up to three signs that are digits or stand for them; two of these count."""
    s = F.upper(F.regexp_replace(_after_colon(strip(c)), r"(?U)\s+", ""))
    p = r"([0-9]{1,2})[.,]([0-9A-Z]{1,3})"
    left, right = F.regexp_extract(s, p, 1), _only_digits(F.translate(F.regexp_extract(s, p, 2), *IN_PERCENT))
    return F.when((left != "") & (right != ""), F.concat(left, F.lit("."), F.substring(F.rpad(right, 2, "0"), 1, 2)).try_cast("double"))


def labelled_id(c: Column) -> Column:
    """The national id of a line such as DNI: 1234..., its last sign repaired to a letter."""
    s = F.upper(strip(c))
    label = F.regexp_replace(F.substring_index(s, ":", 1), "[^A-Z]", "")
    chunks = F.filter(F.regexp_extract_all(_after_colon(s), F.lit("[A-Z0-9]+"), F.lit(0)), lambda x: x.rlike("[0-9]"))
    longest = F.array_max(F.transform(chunks, lambda x, i: F.struct(F.char_length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    token = F.translate(longest, *IN_ID)
    whole = F.regexp_extract(token, "([0-9]{8}[A-Z])", 1)
    body, tail = F.regexp_extract(token, r"([0-9]{8})[0-9A-Z]\z", 1), F.translate(F.regexp_extract(token, r"[0-9]{8}([0-9A-Z])\z", 1), *ID_TAIL)
    repaired = F.when(tail.rlike(r"\A[A-Z]\z"), F.concat(body, tail))
    fits = F.contains(s, F.lit(":")) & label.rlike(rf"\A(?:{ID_LABELS})")
    return F.when(fits, F.coalesce(F.nullif(whole, F.lit("")), repaired))
