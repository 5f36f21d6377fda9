"""Licence scan by a positional index of rare template words, in DataFrame functions only.

Licence templates are texts with mandatory key phrases. Their words are indexed with their positions.
A first pass counts, over all documents, in how many each template word stands (its IDF). A start of a
template in a file is accepted if the words found in place have at least `share` of the template's IDF
weight and every mandatory phrase stands at its place. So of any accepted start one of the template's
rarest words is in place: those that together weigh more than 1 - share of it. They alone are looked up
(`seeds`), and no start is lost.

A second pass takes the file's words of highest IDF, those that are seeds, looks up their postings, and
intersects them by relative position: a place in the file less a place in the template is the
template's start. Each distinct start is then verified: all its words, and the phrases.

The templates are a parameter of bounded size (`WORDS_MOST` distinct words), so that their index
is part of the plan; nothing is shuffled but word counts.

Defined results: null and empty texts have no words, no places, empty labels and score 0; repeated
rows are scanned each by itself; templates without words are ignored; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import lower_ascii, words_of

#: What stands between words: ASCII characters other than letters and digits.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORDS_MOST = 50_000
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must stand at their place in the template.
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [w for w in re.split("[^a-z0-9]+", self.text.lower()) if w]

    @property
    def keys(self) -> list[tuple[int, list[str]]]:
        """Mandatory phrases with their places."""
        found, words = [], self.words
        for phrase in self.mandatory:
            p = phrase.lower().split()
            found.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
        return found


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

# One-line notices, the opening sentences of licences, and whole notices.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache-2.0", APACHE, ("apache license version 2 0", "without warranties or conditions")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-3.0", GPL, ("gnu general public license", "either version 3 of the license")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("mit", MIT, ("permission is hereby granted free of charge", "without warranty of any kind")),
    Template("isc", ISC, ("permission to use copy modify", "the author disclaims all warranties")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", BSD, ("redistribution and use in source and binary forms", "redistributions in binary form")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("mpl-2.0", MPL, ("mozilla public license",)),
    Template("unlicense", UNLICENSE, ("released into the public domain",)),
    Template("proprietary", "All rights reserved", ("all rights reserved",)),
)


def file_words(text: Column) -> Column:
    return words_of(lower_ascii(F.coalesce(text, F.lit(""))), BREAK)


def document_counts(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, int]:
    """Template word -> number of documents that have it, and "" -> number of documents."""
    vocabulary = sorted({w for t in templates for w in t.words})
    if len(vocabulary) > WORDS_MOST:
        raise ValueError(f"templates have {len(vocabulary)} words; at most {WORDS_MOST}")
    there = F.array_distinct(F.filter(file_words(F.col("text")), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(F.array_append(there, F.lit(""))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}  # at most WORDS_MOST + 1 rows


def idf_of(counts: Mapping[str, int], templates: Sequence[Template]) -> dict[str, float]:
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1 for t in templates for w in t.words}


def phrase_places(spaced: Column, phrase: str) -> Column:
    """Places (words from 0) where the phrase stands. spaced: words, each with a space on both sides."""
    # Cut at the phrase's first word, then keep the cuts that its other words follow.
    first, *rest = phrase.split()
    tail = "".join(f" {w} " for w in rest)
    parts = F.split(spaced, f" {first} ")
    start = F.aggregate(
        parts,
        F.struct(F.lit(-1).cast("int").alias("at"), F.lit(True).alias("head"), F.array().cast("array<int>").alias("found")),
        lambda acc, part: F.struct(
            (acc["at"] + 1 + F.size(words_of(part, " +"))).cast("int").alias("at"),
            F.lit(False).alias("head"),
            F.when(~acc["head"] & (part.startswith(tail) if tail else F.lit(True)), F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return start


def base_places(spaced: Column, phrases: Mapping[str, str]) -> dict[str, Column]:
    none = F.array().cast("array<int>")
    return {
        label: F.when(F.contains(spaced, F.lit("".join(f" {w} " for w in phrase.split()))), phrase_places(spaced, phrase)).otherwise(none)
        for phrase, label in phrases.items()
    }


def seeds(template: Template, idf: Mapping[str, float], share: float) -> list[int]:
    """Places of the template's rarest words that together weigh more than a start may miss."""
    own = template.words
    spare, held, chosen = (1 - share) * sum(idf[w] for w in own) * (1 + 1e-9) + 1e-9, 0.0, []
    for i in sorted(range(len(own)), key=lambda i: (-idf[own[i]], i)):
        chosen.append(i)
        held += idf[own[i]]
        if held > spare:
            break
    return chosen


def postings(templates: Sequence[Template], idf: Mapping[str, float], share: float) -> dict[str, list[tuple[int, int]]]:
    """Seed word -> (template, place) of each of its seed places."""
    index = defaultdict(list)
    for t, template in enumerate(templates):
        for i in seeds(template, idf, share):
            index[template.words[i]].append((t, i))
    return dict(index)


def template_hits(words: Column, templates: Sequence[Template], idf: Mapping[str, float], share: float) -> Column:
    """array<struct<label, start, score>> of the supported and verified starts. words: array<string>."""
    index = postings(templates, idf, share)
    look_up = F.create_map(*[x for w, at in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in at]))])
    known = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit([*t.words]).alias("words"), F.lit([idf[w] for w in t.words]).alias("weights"), F.lit(float(sum(idf[w] for w in t.words))).alias("total"),
            F.array(*[F.struct(F.lit(at + j).alias("at"), F.lit(w).alias("w")) for at, phrase in t.keys for j, w in enumerate(phrase)]).alias("keys"),
        )
        for t in templates
    ])
    spots = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(list(index)), i)))
    starts = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(F.element_at(look_up, F.get(words, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["i"]).alias("start"))))))

    def verified(c: Column) -> Column:
        own = F.get(known, c["t"])
        in_place = F.aggregate(F.sequence(F.lit(0), F.size(own["words"]) - 1), F.lit(0.0), lambda acc, j: acc + F.when(F.get(words, c["start"] + j) == F.get(own["words"], j), F.get(own["weights"], j)).otherwise(0.0))
        firm = F.forall(own["keys"], lambda k: F.coalesce(F.get(words, c["start"] + k["at"]) == k["w"], F.lit(False)))
        return F.struct(own["label"].alias("label"), c["start"].alias("start"), F.when(firm, in_place / own["total"]).otherwise(0.0).alias("score"))

    return F.filter(F.transform(starts, verified), lambda h: h["score"] >= share)


def scan(docs: DataFrame, phrases: Mapping[str, str], templates: Sequence[Template] = TEMPLATES, *, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, base (label -> places), hits (label, start, score) of every document.

    phrases: phrase -> label of the plain phrases that are reported wherever they stand."""
    templates = [t for t in templates if t.words]
    words, spaced = F.col("sieve_words"), F.col("sieve_spaced")
    # Words once, each with a space on both sides, so that phrases are found by plain search.
    rows = docs.select("doc_id", file_words(F.col("text")).alias("sieve_words"))
    rows = rows.withColumn("sieve_spaced", F.when(F.size(words) > 0, F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise(""))
    base = F.struct(*[p.alias(label) for label, p in base_places(spaced, phrases).items()])
    hits = F.array().cast("array<struct<label:string,start:int,score:double>>")
    if templates:
        hits = template_hits(words, templates, idf_of(document_counts(docs, templates), templates), share)
    return rows.select("doc_id", F.size(words).cast("long").alias("n_words"), base.alias("base"), hits.alias("hits"))


def digest(scanned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The columns of a report: counts and places of base phrases, labels, and the best score."""
    places = F.array_sort(F.flatten(F.array(*[F.col(f"base.`{x}`") for x in labels])))
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"base.`{x}`")) > 0, F.lit(x)) for x in labels]))
    every = F.array_union(base, F.transform("hits", lambda h: h["label"]))
    best = F.array_max(F.array_append(F.transform("hits", lambda h: h["score"]), F.when(F.size(base) > 0, 1.0).otherwise(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.least(best, F.lit(1.0)).alias("score"),
    )
