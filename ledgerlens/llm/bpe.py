"""Byte-level BPE as a streaming transducer: ids leave as soon as no later text can change them.

Merges are worked rule by rule, in the order of the list. What follows a text can change its
tokens only through a chain of rules, each later in the list than the one before, whose left part
begins the right part of the next; each link moves the place from which tokens may differ to the
left by its left part. The longest chain, in bytes, is the *lookahead*: a token that ends that
many bytes before the end of what has been read is final. So a piece of any length is encoded
with a window of a few lookaheads, and what was emitted is forgotten.

The split into pieces streams as well: a piece is settled three characters before the end of what
has been read, and a run of letters, digits, signs or spaces that grows long is encoded while it goes on.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split of byte-level BPE. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a long piece goes on with, by the kind of its second character.
RUNS = (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")
#: Characters beyond a piece that can decide its end ('re and 've are the longest).
AHEAD = 3
#: A piece of more characters is encoded as it comes.
LONG = 1024
#: Characters fed at once, characters whose new pieces are merged together, pieces remembered by a task, tokens in one Arrow batch.
CHUNK, TOGETHER, REMEMBERED, BATCH_TOKENS = 1 << 16, 1 << 20, 1 << 18, 1 << 20
#: Bits of an id beside its rule's rank, what stands for no rule, and how many bytes are merged without a heap.
ID_BITS, NO_RULE, FEW = 24, 1 << 60, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Ids as four bytes each."""
    return array("i", ids).tobytes()


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of a text within which later text can still change tokens; see the module's text.

    Rules are gone through from the last to the first. ``reach`` holds, for the beginnings of right
    parts seen so far, the longest chain that starts with such a rule.
    """
    reach: dict[bytes, int] = {}
    longest = 0
    for left, right in reversed(merges):
        chain = len(left) + reach.get(left, 0)
        longest = max(longest, chain)
        for i in range(1, len(right) + 1):
            if chain > reach.get(right[:i], 0):
                reach[right[:i]] = chain
    return longest


class Model:
    """Vocabulary, merges, lookahead and added tokens of a tokenizer file; the same on driver and executors."""

    def __init__(self, text: str):
        spec = json.loads(text)
        kind, split = spec["model"], spec["pre_tokenizer"] or {}
        if kind["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer or a prefix space")
        if any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain merges: no dropout, unknown token, affixes, byte fallback or ignored merges")
        alphabet, vocab = byte_alphabet(), kind["vocab"]
        raw = {t: bytes(map(alphabet.__getitem__, t)) for t in vocab if all(c in alphabet for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        made = set(alphabet)
        self.rules: dict[tuple[int, int], int] = {}  # a pair of ids -> its rank and, in the low bits, the id that it becomes
        for rank, (a, b) in enumerate(pairs):
            if a not in made or b not in made or a + b in made:
                raise ValueError(f"merge {rank}: its parts must come from bytes or earlier merges, its result from no other")
            made.add(a + b)
            self.rules[vocab[a], vocab[b]] = rank << ID_BITS | vocab[a + b]
        self.lookahead = lookahead([(raw[a], raw[b]) for a, b in pairs])
        self.window = max(4 * self.lookahead, 2048)
        self.bytes_of = {i: raw[t] if t in raw else t.encode() for t, i in vocab.items()}
        self.added = {}
        for t in spec.get("added_tokens") or []:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that look at their surroundings")
            self.added[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = bytes(map(alphabet.__getitem__, t["content"])) if all(c in alphabet for c in t["content"]) else t["content"].encode()

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes that stand alone: of all pairs the one of the earliest rule, the leftmost first."""
        ids = list(map(self.of_byte.__getitem__, data))
        return self._few(ids) if len(ids) <= FEW else self._many(ids)

    @functools.cached_property
    def tables(self):
        """Ids of bytes, rules of two bytes, and all pairs in order with their rules, as arrays; made where they are used, not sent."""
        import numpy as np

        pairs = sorted((a << ID_BITS | b, rule) for (a, b), rule in self.rules.items())
        keys, found = (np.array([p[i] for p in pairs] + [NO_RULE], dtype=np.int64) for i in range(2))
        bytewise = [self.rules.get((a, b), NO_RULE) for a in self.of_byte for b in self.of_byte]
        return np.array(self.of_byte, dtype=np.int64), np.array(bytewise, dtype=np.int64), keys, found

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """``merged`` of many short pieces, none of them empty, each packed: a round makes one merge in every piece that has one left."""
        import numpy as np

        of_byte, bytewise, keys, rules = self.tables

        def rule_of(left, right):
            wanted = left << ID_BITS | right
            at = np.searchsorted(keys, wanted)
            at[at == len(keys)] = 0
            return np.where(keys[at] == wanted, rules[at], NO_RULE)

        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), list(map(len, pieces)))
        ids, ranks = of_byte[data], np.full(len(data), NO_RULE, dtype=np.int64)  # a place's rank is that of its pair with the next
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = bytewise[data[inner] << 8 | data[inner + 1]]
        done = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(starts, append=len(ids))
            least = np.minimum.reduceat(ranks, starts)
            goes_on = np.repeat(least != NO_RULE, sizes)
            if not goes_on.all():
                done.append((owner[~goes_on], ids[~goes_on]))
                least = np.repeat(least, sizes)[goes_on]
                owner, ids, ranks = owner[goes_on], ids[goes_on], ranks[goes_on]
            else:
                least = np.repeat(least, sizes)
            hits = np.flatnonzero(ranks == least)
            if not len(hits):
                break
            at = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]  # the leftmost
            ids[at] = ranks[at] & (1 << ID_BITS) - 1
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            at -= np.arange(len(at))  # places once those behind them are gone
            owner, ids, ranks = owner[kept], ids[kept], ranks[kept]
            ranks[at] = NO_RULE
            left = np.concatenate((at, at[at > 0] - 1))
            left = left[left < len(ids) - 1]
            left = left[owner[left] == owner[left + 1]]
            ranks[left] = rule_of(ids[left], ids[left + 1])
        owners, ids = (np.concatenate([d[i] for d in done]) if done else np.zeros(0, dtype=np.int64) for i in range(2))
        flat = ids[np.argsort(owners, kind="stable")].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(owners, minlength=len(pieces))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _few(self, ids: list[int]) -> list[int]:
        """By looking for the least rank again and again."""
        rule = self.rules.get
        ranks = [rule(p, NO_RULE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != NO_RULE:
            i = ranks.index(least)
            made = ids[i] = least & (1 << ID_BITS) - 1
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rule((made, ids[i + 1]), NO_RULE)
            if i:
                ranks[i - 1] = rule((ids[i - 1], made), NO_RULE)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """By a heap of ranks and places."""
        n, rules = len(ids), self.rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rules]
        heapq.heapify(heap)
        while heap:
            rule, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            made = ids[i] = rule & (1 << ID_BITS) - 1
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (made, ids[k])) in rules:
                    heapq.heappush(heap, (rules[p], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], made)) in rules:
                heapq.heappush(heap, (rules[p], h, p))
        return [i for i in ids if i >= 0]


def read_model(path: str = VOCABULARY) -> Model:
    """Read on the driver; about 4 MB to send out, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return Model(f.read())


@functools.cache
def odd_classes() -> dict[int, str]:
    """Characters that the split library counts as letters or digits and the tokenizers library does not, or the other way.

    Both know Unicode, but of different years; the tokenizers library decides. Only characters that are new to one of
    them can differ, so those without a category in Python's own tables are asked. Each is given a stand-in of its kind.
    """
    import regex
    from tokenizers import pre_tokenizers

    split, known = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(r"(\p{L})|(\p{N})")
    asked = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn"]
    out = {}
    for at in range(0, len(asked), 1 << 10):
        block = asked[at : at + (1 << 10)]
        signs = "".join(block)
        if not known.search(signs) and len(split.pre_tokenize_str(f"a{signs}1")) == 3:  # signs to both
            continue
        ends = {e for _, (_, e) in split.pre_tokenize_str(" ".join(f"a{c}1" for c in block))}
        for i, c in enumerate(block):
            m = known.match(c)
            taken = "a" if m and m[1] else "1" if m else "."
            wanted = "a" if 4 * i + 1 not in ends else "1" if 4 * i + 2 not in ends else "."
            if wanted != taken:
                out[ord(c)] = wanted
    return out


class Encoder:
    """Ids of a text that comes in parts: ``feed`` gives what is final, ``finish`` the rest.

    Inside, a result is a list of packed ids and of short pieces that are not known yet; ``resolved`` merges those of many results together.
    """

    def __init__(self, model: Model, odd: dict[int, str]):
        import regex

        self.model, self.odd = model, odd
        self.split, self.runs = regex.compile(PATTERN), [regex.compile(r) for r in RUNS]
        # Alternatives are tried in their order: longer added tokens first.
        self.marks = re.compile("|".join(re.escape(t) for t in sorted(model.added, key=len, reverse=True))) if model.added else None
        self.longest_mark = max(map(len, model.added), default=0)
        self.pieces: dict[str, bytes] = {}
        self._start()

    def _start(self) -> None:
        self.raw, self.rest, self.run, self.open = "", "", None, bytearray()

    def feed(self, text: str) -> list[int]:
        return array("i", self.resolved([self.fed(text)])[0]).tolist()

    def finish(self) -> list[int]:
        return array("i", self.resolved([self.finished()])[0]).tolist()

    def resolved(self, results: list[list]) -> list[bytes]:
        """Packed ids of each result."""
        new = list({p for parts in results for p in parts if p.__class__ is str})
        found = dict(zip(new, self.model.merged_together([p.encode() for p in new]), strict=True))
        if len(self.pieces) + len(found) > REMEMBERED:
            self.pieces.clear()
        self.pieces.update(itertools.islice(found.items(), REMEMBERED))
        return [b"".join([found[p] if p.__class__ is str else p for p in parts]) for parts in results]

    def fed(self, text: str) -> list:
        out: list = []
        raw = self.raw + text
        at = 0
        if self.marks:
            # A mark is taken when no longer one can begin at its place.
            for m in self.marks.finditer(raw):
                if len(raw) - m.start() < self.longest_mark:
                    break
                self._segment(raw[at : m.start()], True, out)
                out.append(packed([self.model.added[m[0]]]))
                at = m.end()
        stop = max(at, len(raw) - self.longest_mark + 1) if self.marks else len(raw)
        self._segment(raw[at:stop], False, out)
        self.raw = raw[stop:]
        return out

    def finished(self) -> list:
        out: list = []
        at = 0
        for m in self.marks.finditer(self.raw) if self.marks else ():
            self._segment(self.raw[at : m.start()], True, out)
            out.append(packed([self.model.added[m[0]]]))
            at = m.end()
        self._segment(self.raw[at:], True, out)
        self._start()
        return out

    def _view(self, text: str) -> str:
        try:
            text.encode("latin-1")
            return text
        except UnicodeEncodeError:
            return text.translate(self.odd) if self.odd else text

    def _segment(self, text: str, last: bool, out: list) -> None:
        """Pieces between two added tokens; ``last``: the segment ends with this text."""
        text = self.rest + text
        view, at = self._view(text), 0
        if self.run is not None:
            at = self._go_on(text, view, 0, last, out)
        while True:
            limit = len(text) if last else len(text) - AHEAD
            at = self._settled(text, view, at, limit, out)
            if last or len(text) - at <= LONG:
                break
            m = self.split.match(view, at)
            if m.end() <= limit:
                break
            second = next(k for k, r in enumerate(self.runs) if r.match(view, at + 1).end() > at + 1)
            self.run = second
            self._push(text[at], out)
            at = self._go_on(text, view, at + 1, last, out)
            if self.run is not None:
                break
        self.rest = "" if last else text[at:]

    def _settled(self, text: str, view: str, at: int, limit: int, out: list) -> int:
        if view is text:
            pieces = self.split.findall(text, at)
            end = len(text)
            while pieces and end > limit:
                end -= len(pieces.pop())
            end = max(end, at)
        else:
            pieces, end = [], at
            for m in self.split.finditer(view, at):
                if m.end() > limit:
                    break
                pieces.append(text[m.start() : m.end()])
                end = m.end()
        if max(map(len, pieces), default=0) > FEW:
            for p in pieces:
                out.append(self._long_piece(p) if len(p) > FEW else self.pieces.get(p, p))
        else:
            out.extend(map(self.pieces.get, pieces, pieces))
        return end

    def _long_piece(self, piece: str) -> bytes:
        if len(piece) <= LONG:
            return packed(self.model.merged(piece.encode()))
        ids: list = []
        for i in range(0, len(piece), LONG):
            self._push(piece[i : i + LONG], ids)
        self._close(ids)
        return b"".join(ids)

    def _go_on(self, text: str, view: str, at: int, last: bool, out: list) -> int:
        """What belongs to the open run from ``at`` on; the end of it, or of what can be said yet."""
        end = self.runs[self.run].match(view, at).end()
        if end == len(text) and not last:
            end = max(at, end - AHEAD)
            self._push(text[at:end], out)
            return end
        if end < len(text) and self.runs[self.run].pattern == r"\s*":
            end = max(at, end - 1)  # the last space goes with what follows
        self._push(text[at:end], out)
        self._close(out)
        self.run = None
        return end

    def _push(self, text: str, out: list) -> None:
        data, room = text.encode(), self.model.window
        for i in range(0, len(data), room):
            self.open += data[i : i + room]
            if len(self.open) >= room:
                final, end, settled = len(self.open) - self.model.lookahead, 0, []
                for t in self.model.merged(bytes(self.open)):
                    size = len(self.model.bytes_of[t])
                    if end + size > final:
                        break
                    settled.append(t)
                    end += size
                out.append(packed(settled))
                del self.open[:end]

    def _close(self, out: list) -> None:
        out.append(packed(self.model.merged(bytes(self.open))))
        self.open.clear()


class Decoder:
    """Text of ids that come in parts; bytes of an unfinished character wait, impossible ones become U+FFFD."""

    def __init__(self, model: Model):
        self.bytes_of = model.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        """Ids that the vocabulary lacks have no text."""
        known = self.bytes_of
        return self.state.decode(b"".join([known.get(i, b"") for i in ids]), last)

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: id_col and ids_col, array<int>, the ids of the whole text.

    Strings of added tokens become their ids; no other special tokens are put in. A null or empty text has no
    ids. Repeated rows stay; empty tables stay empty. Rows go one after another through one transducer of a task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((read_model(vocabulary), odd_classes()))

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        own = Encoder(*shared.value)

        def rows(keys, found):
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else [], pa.int32()))], names=["_id", "_ids"])

        for batch in parts:
            found, waiting, start, held, read = [], [], 0, 0, 0
            for i, value in enumerate(batch.column(1)):
                text, ids = value.as_py() or "", []
                for at in range(0, len(text), CHUNK):
                    ids += own.fed(text[at : at + CHUNK])
                    if at % TOGETHER == TOGETHER - CHUNK:  # so much of one text is not left to wait
                        ids = own.resolved([ids])
                waiting.append(ids + own.finished())
                read += len(text)
                if read >= TOGETHER or i + 1 == len(batch):
                    found += [np.frombuffer(x, dtype=np.int32) for x in own.resolved(waiting)]
                    held += sum(map(len, found[-len(waiting) :]))
                    waiting, read = [], 0
                if held >= BATCH_TOKENS:
                    yield rows(batch.column(0)[start : i + 1], found)
                    found, start, held = [], i + 1, 0
            yield rows(batch.column(0)[start:], found)

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(batches, f"_id {kind}, _ids array<int>")
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias(ids_col))


def decode(rows: DataFrame, *, ids_col: str = "ids", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with text_col, the text of ids_col with special tokens written out.

    Null ids in an array and ids that the vocabulary lacks have no text; a null array has an empty one. Bytes that are
    no UTF-8 become U+FFFD, as often as the standard's longest impossible parts.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_model(vocabulary))

    @F.pandas_udf("string")
    def text_of(arrays):
        import pandas as pd

        own = Decoder(shared.value)

        def one(ids):
            ids = [] if ids is None else ids
            parts = [own.feed(ids[at : at + CHUNK].tolist()) for at in range(0, len(ids), CHUNK)]
            return "".join(parts) + own.finish()

        return pd.Series([one(ids) for ids in arrays], dtype=object)

    return rows.withColumn(text_col, text_of(F.filter(F.col(ids_col), lambda i: i.isNotNull())))
