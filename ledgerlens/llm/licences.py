"""Licence scans by a positional index of rare words, in DataFrame functions alone.

The index posts, for each template, its words of highest inverse document frequency together
with their place in the template. A word of a file that is posted proposes the place where the
template would begin. A proposal stands if enough of the template's rare words are at
their relative places, its mandatory phrases are there word for word, and enough
words agree in all. Places may drift by a few words, so an inserted, dropped or changed word breaks no match.

A file is looked at where it is read: nothing is shuffled but the words' document frequencies.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, plain_words


@dataclass(frozen=True)
class Template:
    """text: its plain words, lower-cased, count; phrases: parts that must be there (all of it, if none is named)."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return words_of(self.text)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


# Public licence texts and notices, and the labels they get.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
SPDX_IDS = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense")
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit-text", MIT, ("permission is hereby granted free of charge", "without warranty of any kind")),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-notice", "licensed under the apache license version 2 0", ("licensed under the apache license",)),
    Template("apache-header", APACHE, ("in compliance with the license",)),
    Template("gpl-notice", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl-header", GPL, ("gnu general public license", "free software foundation")),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("bsd", BSD, ("redistribution and use in source and binary forms",)),
    Template("bsd-3", BSD_3, ("to endorse or promote products",)),
    Template("isc", ISC, ("this software for any purpose",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("unlicense", UNLICENSE, ("free and unencumbered software",)),
    Template("spdx", "spdx license identifier"),
    *[Template(f"spdx-{i.lower()}", f"spdx license identifier {i}") for i in SPDX_IDS],
)
#: Words that a template with mandatory phrases posts, and how far its words may drift from their places.
RARE_WORDS, DRIFT = 5, 3

INDEX = (
    "struct<templates:array<struct<label:string,base:boolean,words:array<string>,rare:array<int>,votes:int,phrases:array<struct<from:int,n:int>>,share:double,drift:int>>,"
    "posts:map<string,array<struct<t:int,offset:int>>>>"
)
MATCHES = "array<struct<at:int,long:int,label:string,base:boolean,agreed:double>>"


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all documents each of the templates' words is; the words are a fixed few."""
    own = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    rows = words.select(F.explode(F.array_intersect("words", own)).alias("word"))
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count("*").alias("n")).collect()}


def index_of(templates, df: dict[str, int]) -> dict:
    """The templates, and for each posted word the templates and places it is posted for. Fewer documents, higher IDF; ties go to the earlier place."""
    known, posts = [], {}
    for t, x in enumerate(templates):
        words = x.words
        first = {w: i for i, w in reversed(list(enumerate(words)))}  # a word is posted for one place
        rare = sorted(first.values(), key=lambda i: (df.get(words[i], 0), i))[: RARE_WORDS if x.phrases else 1]
        places = []
        for phrase in x.phrases or (x.text,):
            p = words_of(phrase)
            places.append({"from": next(i for i in range(len(words)) if words[i : i + len(p)] == p), "n": len(p)})
        known.append({"label": x.label, "base": x.base, "words": words, "rare": sorted(rare), "votes": max(1, math.ceil(len(rare) * 2 / 3)), "phrases": places, "share": x.share, "drift": DRIFT if x.phrases else 0})
        for i in rare:
            posts.setdefault(words[i], []).append({"t": t, "offset": i})
    return {"templates": known, "posts": posts}


def _verified(words: Column, at: Column, p: Column) -> Column:
    """struct<at, long, label, base, agreed> if the template stands at the place or within its drift, else null."""
    n, drift = F.size(p["words"]), p["drift"]

    def near(i: Column) -> Column:
        """Whether the template's i-th word is at its place, or within the drift of it."""
        first = F.greatest(at + i - drift, F.lit(0))
        return F.array_contains(F.slice(words, first + 1, F.greatest(at + i + drift + 1 - first, F.lit(0))), F.get(p["words"], i))

    votes = F.size(F.filter(p["rare"], near))
    shifts = F.sequence(-drift, drift)
    phrase = lambda x: F.exists(shifts, lambda d: (at + x["from"] + d >= 0) & (F.slice(words, F.greatest(at + x["from"] + d, F.lit(0)) + 1, x["n"]) == F.slice(p["words"], x["from"] + 1, x["n"])))
    agreed = F.size(F.filter(F.sequence(F.lit(0), n - 1), near)) / n
    stood = F.struct(at.alias("at"), n.alias("long"), p["label"].alias("label"), p["base"].alias("base"), agreed.alias("agreed"))
    told = F.when((at + drift >= 0) & (votes >= p["votes"]), F.when(F.forall(p["phrases"], phrase), let(stood, lambda x: F.when(x["agreed"] >= p["share"], x))))
    return told


def _matches(words: Column, index: Column, many: int, below: int) -> Column:
    """All matches in the words of a file that has a posted word; of ``many`` templates with ``below`` words at most."""
    posts, templates = index["posts"], index["templates"]
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.map_contains_key(posts, w), F.struct(w.alias("word"), i.alias("place")))), lambda h: h.isNotNull())
    # A proposal is one number: a place, which the first offsets may take below zero, and a template. Numbers are told apart by hashing, however many.
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(posts[h["word"]], lambda p: (h["place"] - p["offset"] + below).cast("long") * many + p["t"])))
    parted = F.transform(F.array_distinct(proposed), lambda p: F.struct((F.call_function("div", p, F.lit(many)) - below).cast("int").alias("at"), F.pmod(p, F.lit(many)).cast("int").alias("t")))
    stood = F.filter(F.transform(parted, lambda p: _verified(words, p["at"], F.get(templates, p["t"]))), lambda m: m.isNotNull())

    def best(all_: Column) -> Column:
        # of proposals that drifted apart the one with most agreement counts; they stand next to one another
        better = lambda m: lambda o: (o["label"] == m["label"]) & (F.abs(o["at"] - m["at"]) <= DRIFT) & ((o["agreed"] > m["agreed"]) | ((o["agreed"] == m["agreed"]) & (o["at"] < m["at"])))
        around = lambda i: F.slice(all_, F.greatest(i - 2 * DRIFT, F.lit(0)) + 1, F.lit(4 * DRIFT + 1))
        return F.filter(all_, lambda m, i: m["base"] | ~F.exists(around(i), better(m)))

    by_label = F.transform(F.array_sort(F.transform(stood, lambda m: F.struct(m["label"].alias("label"), m["at"].alias("at"), m.alias("m")))), lambda x: x["m"])
    return F.array_sort(let(by_label, best)).cast(MATCHES)


def scan_licences(docs: DataFrame, templates=TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, matches array<struct<at,long,label,base,agreed>>.

    ``at`` counts words from 0 and may be below it by the drift. Base templates match word for word, at every place; others
    may lack some words, or have some more, but no mandatory phrase. A null or empty text has no words and no matches;
    repeated rows each get a result; an empty table gives an empty result; other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("_id"), plain_words(F.col(text_col)).alias("words"))
    df = document_frequencies(base, sorted({w for t in templates for w in t.words}))
    found = index_of(templates, df)
    index = F.from_json(F.lit(json.dumps(found)), INDEX)
    posted = F.from_json(F.lit(json.dumps(sorted(found["posts"]))), "array<string>")
    none = F.array().cast(MATCHES)
    matches = F.when(F.arrays_overlap("words", posted), _matches(F.col("words"), index, len(templates), max((len(t.words) for t in templates), default=0))).otherwise(none)
    return base.select(F.col("_id").alias(id_col), F.size("words").cast("long").alias("n_words"), matches.alias("matches"))
