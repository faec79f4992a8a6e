"""Dates and flags on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip

TRUE_WORDS = ("true", "t", "1", "si", "sí", "s")
FALSE_WORDS = ("false", "f", "0", "no", "n")


def parse_date(c: Column) -> Column:
    """A date of yyyy-MM-dd, yyyyMMdd or d/M/yyyy, each stroke of which may be a dash; null where it is none."""
    s = strip(c)
    local = F.translate(s, "-", "/")
    tries = ((s, r"\A\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"), (s, r"\A\d{8}\z", "yyyyMMdd"), (local, r"\A\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"))
    return F.coalesce(*[F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(f))).cast("date") for x, p, f in tries])


def parse_iso_date(c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike(p), F.try_to_timestamp(c, F.lit(f))).cast("date") for p, f in ((r"\A\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"), (r"\A\d{8}\z", "yyyyMMdd"))])


#: Date, time, fraction, offset of an ISO text.
ISO_DATETIME = r"\A(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2}(?::\d{2})?)?)(?:[.,](\d+))?(Z|[+-]\d{2}(?::?\d{2})?)?)?\z"


def iso_datetime(c: Column) -> Column:
    """An ISO date with a time, or without one, as yyyy-MM-ddTHH:mm:ss, with six digits of a fraction that isn't zero and the offset as +HH:mm; null where it is none.

    Digits of a fraction beyond the sixth are cut off. An offset stays as it is written, the time is not moved by it; it is less than a day.
    """
    s = strip(c)
    part = lambda i: F.regexp_extract(s, ISO_DATETIME, i)
    local = F.concat(part(1), F.lit("T"), part(2), F.substring(F.lit("00:00:00"), F.char_length(part(2)) + 1, F.lit(8))).try_cast("timestamp_ntz")
    fraction = F.substring(F.rpad(part(3), 6, "0"), 1, 6)
    offset = F.replace(part(4), F.lit(":"), F.lit(""))
    hours, minutes = F.substring(offset, 2, 2).try_cast("int"), F.coalesce(F.substring(offset, 4, 2).try_cast("int"), F.lit(0))
    moved = F.when(part(4).isin("", "Z"), True).otherwise((hours < 24) & (minutes < 60))
    sign = F.when((hours == 0) & (minutes == 0), "+").otherwise(F.substring(offset, 1, 1))
    shown = F.when(part(4) == "", "").when(part(4) == "Z", "+00:00").otherwise(F.concat(sign, F.substring(offset, 2, 2), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0")))
    whole = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction.isin("000000"), "").otherwise(F.concat(F.lit("."), fraction)), shown)
    return F.when(s.rlike(ISO_DATETIME) & moved & local.isNotNull(), whole)


def parse_flag(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def csv_flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes", "si", "sí"), F.lit(False))


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / 365.25
