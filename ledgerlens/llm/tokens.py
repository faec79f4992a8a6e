"""Token counts with offset-mapped attribution.

A document is encoded once, whole. The tokens' byte lengths give their places in the text, and an
interval join by sorted edges assigns them to sections. A token that crosses an edge goes, by
rule, to the section of its ``first`` character, of its ``last``, or to the one that holds the
``largest`` part of it (the earlier, in a tie). Tokens that touch no section count as outside.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "largest")


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a vocabulary file; read on the driver, about 1 MB to send out."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def line_edges(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends, in characters, of the lines of a text, each with its line feed."""
    starts, at = [], 0
    for line in text.split("\n"):
        starts.append(at)
        at += len(line) + 1
    if starts[-1] >= len(text):  # nothing after the last line feed
        starts.pop()
    return starts, [*starts[1:], len(text)] if starts else []


class Attributor:
    def __init__(self, ranks: dict[bytes, int], pattern: str, rule: str):
        import numpy as np
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.rule = rule

    def encode(self, text: str):
        import numpy as np

        return np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)

    def spans(self, text: str):
        """First character of each token and the end of its last one; parts of a character count as it."""
        import numpy as np

        ends = np.cumsum(self.lengths[self.encode(text)])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if len(data) == len(text):
            return starts, ends
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1

    def attribute(self, text: str, starts, ends):
        """(tokens of each section, tokens outside, crossing tokens) for sorted, disjoint sections [start, end)."""
        import numpy as np

        a, b = self.spans(text)
        s, e = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64)
        if not len(s):
            return np.zeros(0, dtype=np.int64), len(a), 0
        lo = np.searchsorted(e, a, side="right")  # first section that ends after the token's start
        hi = np.searchsorted(s, b, side="left") - 1  # last section that begins before its end
        touched = np.maximum(hi - lo + 1, 0)
        own = lo.copy() if self.rule != "last" else hi.copy()
        if self.rule == "largest":
            for i in np.flatnonzero(touched > 1):
                j = np.arange(lo[i], hi[i] + 1)
                own[i] = j[np.argmax(np.minimum(e[j], b[i]) - np.maximum(s[j], a[i]))]
        inside = touched > 0
        crossing = int((inside & ((a < s[np.minimum(lo, len(s) - 1)]) | (b > e[np.minimum(lo, len(s) - 1)]))).sum())
        return np.bincount(own[inside], minlength=len(s)), int((~inside).sum()), crossing


def attribute_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, n_outside, n_crossing, sections array<struct<section,start,end,tokens>>.

    sections_col holds array<struct<section string, start int, end int>> in characters; without it
    lines are the sections, named by their number from 0. Null or empty sections are left out,
    parts beyond the text are cut off, and where two overlap the one that starts later begins at
    the other's end. All tokens are counted once: n_tokens is the sum over sections plus
    n_outside. A null or empty text has no tokens. Repeated rows stay; empty tables stay empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {RULES}")
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    named = F.col(sections_col) if sections_col else F.lit(None).cast("array<struct<section:string,start:int,end:int>>")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), named.alias("_sections"))

    def given(sections, n):
        out, at = [], 0
        for x in sorted((x for x in sections or [] if x and x["start"] is not None and x["end"] is not None), key=lambda x: (x["start"], x["end"])):
            start, end = max(x["start"], at, 0), min(x["end"], n)
            if start < end:
                out.append((x["section"], start, end))
                at = end
        return out

    def batches(parts):
        import pyarrow as pa

        own = Attributor(shared.value, pattern, rule)
        inner = pa.struct([("section", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int64())])
        for batch in parts:
            n_tokens, n_outside, n_crossing, offsets, names, starts, ends, counts = [], [], [], [0], [], [], [], []
            for value, asked in zip(batch.column(1), batch.column(2), strict=True):
                text = value.as_py() or ""
                if sections_col:
                    found = given(asked.as_py(), len(text))
                    labels, s, e = ([x[i] for x in found] for i in range(3))
                else:
                    s, e = line_edges(text)
                    labels = list(map(str, range(len(s))))
                per, outside, crossing = own.attribute(text, s, e)
                n_tokens.append(int(per.sum()) + outside)
                n_outside.append(outside)
                n_crossing.append(crossing)
                names += labels
                starts += s
                ends += e
                counts.append(per)
                offsets.append(len(names))
            import numpy as np

            flat = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], fields=list(inner)
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_outside, pa.int64()), pa.array(n_crossing, pa.int64()), lists], names=["_id", "n_tokens", "n_outside", "n_crossing", "sections"])

    out = rows.mapInArrow(batches, f"_id {kind}, n_tokens long, n_outside long, n_crossing long, sections array<struct<section:string,start:int,end:int,tokens:long>>")
    return out.withColumnRenamed("_id", id_col)
