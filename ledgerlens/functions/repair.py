"""What no built-in expresses: tolerant JSON, seeded degradation, close matches. Arrow-batched."""

from __future__ import annotations

import difflib
import json
import random
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Reader:
    """One pass over almost-JSON: comments, trailing commas, either quote, Python literals, local numbers."""

    SPACE = re.compile(r"(?:\s+|//[^\r\n]*|/\*.*?(?:\*/|\Z))*", re.S)
    WORD = re.compile(r"[A-Za-z_]+")
    NUMBER = re.compile(r"[-+]?[0-9][0-9.,]*(?:[eE][-+]?[0-9]+)?")
    WORDS = {"true": True, "false": False, "null": None, "none": None}

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = self.SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.skip()
        if c in "{[" and c:
            return self.container(c)
        if c in "\"'" and c:
            return self.string(c)
        m = self.NUMBER.match(self.text, self.at)
        if m:
            token = m.group().rstrip(",")
            self.at += len(token)
            return local_number(token)
        m = self.WORD.match(self.text, self.at)
        if m and m.group().lower() in self.WORDS:
            self.at = m.end()
            return self.WORDS[m.group().lower()]
        raise ValueError(f"no value at {self.at}")

    def container(self, opening: str):
        self.at += 1
        closing, pairs, items = "}" if opening == "{" else "]", {}, []
        while True:
            c = self.skip()
            if c == closing:
                self.at += 1
                return pairs if opening == "{" else items
            if opening == "{":
                key = self.string(c) if c in "\"'" and c else self.fail()
                if self.skip() != ":":
                    self.fail()
                self.at += 1
                pairs[key] = self.value()
            else:
                items.append(self.value())
            c = self.skip()
            if c == ",":
                self.at += 1
            elif c != closing:
                self.fail()

    def string(self, quote: str) -> str:
        end = self.at + 1
        while end < len(self.text) and self.text[end] != quote:
            end += 2 if self.text[end] == "\\" else 1
        if end >= len(self.text):
            self.fail()
        raw, self.at = self.text[self.at + 1 : end], end + 1
        if quote == "'":
            raw = raw.replace("\\'", "'").replace('"', '\\"')
        return json.loads(f'"{raw}"', strict=False)

    def fail(self):
        raise ValueError(f"not JSON at {self.at}")


def local_number(token: str):
    """An int or float of a token with separators for thousands or decimals, or what JSON reads."""
    try:
        return json.loads(token)
    except ValueError:
        pass
    groups = re.split("[.,]", token)
    marks = re.findall("[.,]", token)
    if len(marks) == 1 and marks[0] == "," and len(groups[1]) <= 2:
        return float(f"{groups[0]}.{groups[1]}")
    if len(set(marks)) == 2 and 1 <= len(groups[-1]) <= 2 and all(len(g) == 3 for g in groups[1:-1]):
        return float("".join(groups[:-1]) + "." + groups[-1])
    if set(marks) == {","} and all(len(g) == 3 for g in groups[1:]):
        return int("".join(groups))
    if set(marks) == {"."} and len(marks) >= 2:
        return float("".join(groups[:-1]) + "." + groups[-1]) if len(groups[-1]) <= 2 else int("".join(groups))
    raise ValueError(f"number: {token}")


def read_json(text: str | None):
    """The value of almost-JSON; of a fence its inside, else the outermost list or object if the whole is none."""
    raw = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", raw, re.I | re.S)
    raw = fence.group(1) if fence else raw
    tries = [raw]
    for a, b in ("[]", "{}"):
        lo, hi = raw.find(a), raw.rfind(b)
        if -1 < lo < hi:
            tries.append(raw[lo : hi + 1])
    error = None
    for t in tries:
        try:
            reader = _Reader(t)
            value = reader.value()
            if reader.skip():
                reader.fail()
            return value
        except (ValueError, RecursionError) as e:
            error = e
    raise ValueError(f"no JSON: {error}")


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """Canonical JSON of almost-JSON; null where nothing can be read."""

    def one(t):
        try:
            return json.dumps(read_json(t), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def parsed_json(c):
    """The text as JSON: as it is if it is JSON, else repaired; Python sees the rest alone."""
    fine = F.try_parse_json(c)
    return F.when(fine.isNotNull(), c).otherwise(repaired_json(F.when(fine.isNull(), c)))


# Rewrites of a degraded reading, in order, each with its chance; then swaps and losses every 250 characters.
REWRITES = (
    (0.6, "€", "EUR"),
    (0.6, r"(\d)\.(\d{3})", r"\1\2"),
    (0.6, r"(\d),(\d{2})", r"\1.\2"),
    (0.4, "[OI]", {"O": "0", "I": "1"}),
    (0.5, "[–—−]", "-"),
    (0.7, r"\s+", " "),
)
STRIDE, SWAP, LOSS = 250, 0.15, 0.10


def degrade_text(text: str, seed: int) -> str:
    """A worse reading of a text, the same for the same seed."""
    rng = random.Random(seed)
    for chance, pattern, new in REWRITES:
        if rng.random() < chance:
            text = re.sub(pattern, new if isinstance(new, str) else lambda m, table=new: table[m.group()], text)
    signs = list(text)
    for i in range(0, len(signs), STRIDE):
        if i + 1 < len(signs) and rng.random() < SWAP:
            signs[i : i + 2] = signs[i + 1], signs[i]
        if rng.random() < LOSS:
            signs[i] = ""
    return "".join(signs)


@F.pandas_udf(T.StringType())
def degraded(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else degrade_text(t, int(s)) for t, s in zip(texts, seeds, strict=True)])


def document_seed(digest, run_seed):
    """The seed of a document in a run: the first 8 hex digits of its SHA-256, exclusive-or the run's seed."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.lit(run_seed).cast("bigint"))


def close_match(words: list[str], cutoff: float = 0.3):
    """A function of a Column: the word most like a text by matching blocks, null below the cutoff."""

    @F.pandas_udf(T.StringType())
    def match(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next(iter(difflib.get_close_matches(t, words, 1, cutoff)), None) if t else None)

    return match


@F.pandas_udf(T.DoubleType())
def python_round(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Half to even on the binary value, where a tie's last cent matters: round() rounds the decimal text."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(values, digits, strict=True)])


def coerced_payload(payload):
    """struct<fields: map<string,string>, details: map<string,string>> of what an extractor gave as JSON.

    An object with both ``fields`` and ``details``, objects or nothing, gives these; any other object is the fields
    itself; all else gives two empty maps. Values that are no texts stand as JSON.
    """
    v = F.try_parse_json(payload)
    form = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    held = lambda path: F.coalesce(form(path).startswith("OBJECT") | (form(path) == "VOID"), F.lit(False))
    part = lambda path: F.coalesce(F.try_variant_get(v, path, "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = held("$.fields") & held("$.details")
    return F.struct(F.when(both, part("$.fields")).otherwise(part("$")).alias("fields"), F.when(both, part("$.details")).otherwise(F.create_map().cast("map<string,string>")).alias("details"))
