"""Number functions on Columns: local formats, OCR repair, rescaling, loans, tax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip

# Letters that OCR puts for digits, inside numbers.
OCR_DIGITS = {"0": "oOqQ", "1": "iIlL", "2": "zZ", "5": "sS", "8": "bB", "6": "eE"}
PLAIN = r"\A[-+]?(?:[0-9]+(?:[.,][0-9]+)?|[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?)\z"
#: Digits with separators anywhere, the last of them before one or two digits.
CENTS = r"\A[0-9,.]*[0-9][0-9,.]*[,.][0-9]{1,2}\z"
_DIGITS = "[0-9]+(?:_[0-9]+)*+"
NUMERIC = rf"\A\s*[-+]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][-+]?{_DIGITS})?\s*\z"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, so that nested readings don't grow by every use of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A digit with a letter behind it that OCR may have put for one; nothing is repaired where there is none.
REPAIRABLE = r"(?U)[0-9][\s€$]*[oOqQiIlLzZsSbBeE]"
#: A number with one separator at most: it is decimal.
SIMPLE = r"\A[-+]?[0-9]+(?:[.,][0-9]+)?\z"


def parse_number(c: Column, repair: bool = True) -> Column:
    """A double of a local number text such as 2.445,37 EUR; null where it is none.

    Two or more separators: the last is decimal if one or two digits follow, else all are for
    thousands. A single separator is always decimal. Texts that are plain numbers, which most are, take no more than one look.
    """
    bare = lambda x: F.regexp_replace(x, r"[^0-9,.+-]", "")
    kept = bare(c)
    if repair:
        s = F.regexp_replace(F.regexp_replace(strip(c), "[€$]", ""), r"(?U)\s+", "")
        for digit, wrong in OCR_DIGITS.items():
            s = F.regexp_replace(s, rf"(?<=[0-9])[{wrong}](?=[0-9,.+-])", digit)
        kept = F.when(c.rlike(REPAIRABLE), bare(s)).otherwise(kept)
    read = let(F.regexp_replace(kept, r"(?<=[0-9])[,.](?=[,.])", ""), _read_number)
    return F.when(c.rlike(SIMPLE), F.replace(c, F.lit(","), F.lit(".")).try_cast("double")).otherwise(read)


def _read_number(s: Column) -> Column:
    sign, body = F.regexp_extract(s, r"\A([-+]?)", 1), F.regexp_replace(s, r"\A[-+]", "")
    whole = F.translate(F.regexp_replace(body, r"[,.][0-9]{1,2}\z", ""), ",.", "")
    cents = F.concat(sign, whole, F.lit("."), F.regexp_extract(body, r"[,.]([0-9]{1,2})\z", 1))
    out = F.when(s.rlike(SIMPLE), F.replace(s, F.lit(","), F.lit("."))).when(body.rlike(CENTS), cents).when(s.rlike(PLAIN), F.concat(sign, F.translate(body, ",.", "")))
    return out.try_cast("double")


def strict_number(c: Column) -> Column:
    """A double of a text that is a number as it stands, digits grouped by _ or not. try_cast alone also takes 5d."""
    return F.when(c.rlike(NUMERIC), F.translate(F.trim(c), "_", "").try_cast("double"))


def as_integer(number: Column) -> Column:
    """As a bigint if there is nothing after the point, else null."""
    return F.when(number == F.floor(number), number.cast("bigint"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def monthly_payment(principal: Column, annual_rate: Column, months: Column) -> Column:
    """The constant payment of a loan; null for what makes no loan."""
    rate = annual_rate / 100.0 / 12.0
    paid = principal * rate / F.nullif(1.0 - F.pow(1.0 + rate, -months), F.lit(0.0))
    fine = (principal > 0) & (months > 0) & (annual_rate >= 0)
    return F.when(fine & (rate == 0), principal / months).when(fine, paid)


def principal_of(payment: Column, annual_rate: Column, months: Column) -> Column:
    rate = annual_rate / 100.0 / 12.0
    fine = (payment > 0) & (months > 0) & (annual_rate >= 0)
    return F.when(fine & (rate == 0), payment * months).when(fine, payment * (1.0 - F.pow(1.0 + rate, -months)) / rate)


def _first_of_each(candidates: Column) -> Column:
    values = F.transform(candidates, lambda x: x["value"])
    return F.filter(candidates, lambda x, i: F.array_position(values, x["value"]) == i + 1)


def seeds_of(number: Column, text: Column) -> Column:
    """What a raw value may have meant: the number, or the text's parsed number and its digits alone."""
    only_digits = F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit("")).try_cast("double")
    own = F.when(number.isNotNull(), F.array(number)).otherwise(F.array(parse_number(text), only_digits))
    return F.filter(own, lambda x: x.isNotNull())


def scaled_candidates(seeds: Column, digits: int = 4, most: int = 4) -> Column:
    """array<struct<value, shift>>: seeds by powers of ten, down and up, each value once, where it came first."""

    def of(seed):
        steps = [F.struct(F.round(seed, digits).alias("value"), F.lit(0).alias("shift"))]
        for p in range(1, most + 1):
            steps.append(F.struct(F.round(seed / float(10**p), digits).alias("value"), F.lit(p).alias("shift")))
            steps.append(F.struct(F.round(seed * float(10**p), digits).alias("value"), F.lit(p).alias("shift")))
        return F.array(*steps)

    return let(F.flatten(F.transform(seeds, of)), _first_of_each)


def candidate_score(value: Column, shift: Column, low: Column | None = None, high: Column | None = None, target: Column | None = None) -> Column:
    score = shift.cast("double")
    if low is not None:
        score = score + F.when(value < low, 100.0 + (low - value) / F.greatest(F.abs(low), F.lit(1.0))).otherwise(0.0)
    if high is not None:
        score = score + F.when(value > high, 100.0 + (value - high) / F.greatest(F.abs(high), F.lit(1.0))).otherwise(0.0)
    if target is not None:
        score = score + F.coalesce(F.abs(value - target) / F.greatest(F.abs(target), F.lit(1.0)) * 8.0, F.lit(0.0))
    return score


def rescaled(current: Column, number: Column, text: Column, low: Column | None = None, high: Column | None = None, digits: int = 4) -> Column:
    """The current value if it lies in range, else the candidate of the lowest score if that beats the current one's."""
    inside = F.coalesce(current.isNotNull() & (F.lit(True) if low is None else current >= low) & (F.lit(True) if high is None else current <= high), F.lit(False))
    rated = F.transform(scaled_candidates(seeds_of(number, text), digits), lambda x, i: F.struct(candidate_score(x["value"], x["shift"], low, high).alias("score"), i.alias("at"), x["value"].alias("value")))
    now = F.when(current.isNotNull(), candidate_score(current, F.lit(0), low, high)).otherwise(F.lit(float("inf")))
    return let(F.array_min(rated), lambda best: F.when(~inside & (best["score"] < now), best["value"]).otherwise(current))


def money_candidates(number: Column, text: Column) -> Column:
    """array<double>: what an amount may have been, its separators lost."""
    plain = F.nullif(F.regexp_replace(text, r"[^0-9]", ""), F.lit(""))
    value, n = plain.try_cast("double"), F.char_length(plain)
    own = [F.round(parse_number(text), 2), F.round(value, 2)] + [F.when(n >= k, F.round(value / d, 2)) for k, d in ((2, 10.0), (3, 100.0), (4, 1000.0))]
    of_text = F.array_distinct(F.filter(F.array(*own), lambda x: x.isNotNull()))
    return F.when(number.isNotNull(), F.array(F.round(number, 2))).otherwise(of_text)


def nearest_money(current: Column, expected: Column, number: Column, text: Column, tolerance: float = 0.15) -> Column:
    """The current amount if it is as expected, else the candidate that is and is nearer."""
    error = F.coalesce(F.abs(current - expected), F.lit(float("inf")))
    best = F.array_min(F.transform(money_candidates(number, text), lambda x, i: F.struct(F.abs(x - expected).alias("error"), i.alias("at"), x.alias("value"))))
    wrong = F.coalesce(expected.isNotNull() & (error > tolerance), F.lit(False))
    chosen = let(F.when(wrong, best), lambda b: F.when((b["error"] <= tolerance) & (b["error"] < error), b["value"]))
    return F.coalesce(chosen, current)


def inferred_rate(base: Column, quota: Column, total: Column, withheld: Column, rates) -> Column:
    """The legal rate that the amounts imply, at most 1.25 points away; the quota's view first in ties."""
    seen = [F.when((base > 0) & quota.isNotNull(), quota / base * 100.0), F.when((base > 0) & total.isNotNull(), (total + F.coalesce(withheld, F.lit(0.0)) - base) / base * 100.0)]
    rated = F.filter(F.array(*[F.struct(F.abs(s - float(r)).alias("error"), F.lit(i).alias("at"), F.lit(r).alias("rate")) for i, (s, r) in enumerate((s, r) for s in seen for r in rates)]), lambda x: x["error"].isNotNull())
    return let(F.array_min(rated), lambda best: F.when(best["error"] <= 1.25, best["rate"]))


def p95_exclusive(values: Column) -> Column:
    """The last of 20 exclusive quantiles of an array; of one value that value, of none 0. Two may extrapolate."""
    x = F.array_sort(values)
    n = F.size(x)
    j = F.greatest(F.lit(1), F.least(F.floor((n + 1) * 19 / 20).cast("int"), n - 1))
    d = (n + 1) * 19 - j * 20
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.get(x, F.lit(0))).otherwise((F.get(x, j - 1) * (20 - d) + F.get(x, j) * d) / 20)


def p95_by_index(values: Column) -> Column:
    x = F.array_sort(values)
    return F.get(x, F.floor((F.size(x) - 1) * 0.95).cast("int"))
