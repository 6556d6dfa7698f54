"""License scan with a positional rare-token index, in DataFrame functions alone.

Texts (A-Z lower-cased) are split into words; only places of words that some licence template has are kept, as two arrays a document. Document
frequencies of these words over the whole table give each template's rarest words, RARE at most, however common they are. Every place of such
a word is looked up in the index (word -> template, place in it): it votes for the template at a relative position, that is the place in the
text less the place in the template. Places where a template's mandatory phrase stands word for word vote too. A template is found where its
phrase and at least `share` of its rarest words stand in one band of relative positions; a band is twice `slack` words wide, which
allows for as many inserted or left out words, and bands overlap by half, so that no `slack` neighbouring positions are split.

Base labels come from phrases that stand consecutively, wherever they stand.

Defined cases: a null text is empty; a document without places has null first_word and last_word and empty labels; places that overlap
count each; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 8

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Warranty clauses that several licences share.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# Label, text of the licence or of its usual notice, mandatory phrase in it.
TEXTS = [
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "permission is hereby granted",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "in compliance with the license",
    ),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "gnu general public license",
    ),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "lesser general public license",
    ),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", BSD_HEAD + BSD_TAIL, "redistribution and use in source and binary forms"),
    (
        "bsd",
        BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_TAIL,
        "to endorse or promote products derived from this software",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "this software for any purpose with or without fee",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mozilla public license",
    ),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        "unencumbered software",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "the origin of this software must not be misrepresented",
    ),
    (
        "bsl",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "to prepare derivative works of the software",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc", "this work is licensed under a creative commons license", "creative commons"),
]

#: Label, words of the template joined by a space, mandatory phrase.
TEMPLATES = [(label, " ".join(re.findall("[a-z0-9]+", text.lower())), phrase) for label, text, phrase in TEXTS]
VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in BASE.values() for w in p.split()})


def places(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, at, word): places of licence words in each text, ascending, and the words."""
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    out = out.withColumn("at", F.filter(F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), i)), lambda i: i.isNotNull()))
    return out.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "at", F.transform("at", lambda i: F.get("words", i)).alias("word"))


def phrase_starts(phrase: str, anchor: int = 0) -> Column:
    """Where the phrase's words stand consecutively, found by the word `anchor` of it."""
    words = phrase.split()

    def stands(j: Column) -> Column:
        found = F.lit(True)
        for k, w in enumerate(words):
            if k != anchor:
                found = found & (F.get("word", j + (k - anchor)) == w) & (F.get("at", j + (k - anchor)) == F.get("at", j) + (k - anchor))
        return found

    inside = F.filter(F.transform("word", lambda w, j: F.when((w == words[anchor]) & stands(j), F.get("at", j) - anchor)), lambda p: p.isNotNull())
    return F.when(F.array_contains("word", words[anchor]) & F.array_contains("word", words[-1]), inside).otherwise(F.array().cast("array<int>"))


def rarest(counts: dict[str, int], text: str) -> list[str]:
    """The template's words to look up: the rarest three fifths of its distinct words, RARE at most."""
    words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
    return words[: min(RARE, -(-3 * len(words) // 5))]


def slack(text: str) -> int:
    """By how many words places may differ from the template's."""
    return max(4, len(text.split()) // 8)


def votes_of(template: int, starts: Column, must: int, slack: int) -> Column:
    """Votes for the template of its phrase, which stands at the starts and `must` words after the template's beginning."""
    return F.transform(starts, lambda p: F.struct(F.lit(template).alias("template"), (p - must).alias("offset"), F.lit(slack).alias("slack"), F.lit(1 << RARE).alias("bit")))


def scan(docs: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    spark = docs.sparkSession
    seen = stage(places(docs))
    counts = {r["word"]: r["n"] for r in seen.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # of the vocabulary alone
    postings, votes, starts, anchors = [], {}, [], {}
    for k, (label, text, phrase) in enumerate(TEMPLATES):
        words, must, rare = text.split(), phrase.split(), rarest(counts, text)
        votes[k] = (label, len(rare))
        postings += [(w, k, i, slack(text), 1 << rare.index(w)) for i, w in enumerate(words) if w in rare]
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        anchor = min(range(len(must)), key=lambda i: counts.get(must[i], 0))  # the highest IDF
        anchors[phrase] = anchor
        starts.append(votes_of(k, F.col(f"p{list(anchors).index(phrase)}"), at, slack(text)))
    index = spark.createDataFrame(postings, "w string, template int, place int, slack int, bit int")
    rules = spark.createDataFrame([(k, label, n) for k, (label, n) in votes.items()], "template int, label string, rare int")
    lookups = sorted({w for w, *_ in postings})
    hits = F.filter(F.transform("word", lambda w, j: F.when(w.isin(lookups), F.struct(F.get("at", j).alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    # a text without any mandatory phrase has no template
    phrases = seen.select("row", "at", "word", *(phrase_starts(p, anchor).alias(f"p{k}") for k, (p, anchor) in enumerate(anchors.items())))
    phrases = phrases.select("row", "at", "word", F.concat(*starts).alias("phrases")).where(F.size("phrases") > 0)
    phrases = stage(phrases.select("row", "phrases", hits.alias("hits")))
    events = phrases.select("row", F.inline("hits")).join(F.broadcast(index), "w")
    events = events.select("row", "template", (F.col("p") - F.col("place")).alias("offset"), "slack", "bit").unionByName(phrases.select("row", F.inline("phrases")))
    bands = F.array(*(F.struct(F.lit(g).alias("grid"), F.floor((F.col("offset") + g * F.col("slack")) / (2 * F.col("slack"))).alias("band")) for g in (0, 1)))
    near = events.select("row", "template", "bit", F.inline(bands)).groupBy("row", "template", "grid", "band").agg(F.bit_or("bit").alias("bits"))
    near = near.join(F.broadcast(rules), "template").select("row", "label", "bits", (F.bit_count(F.col("bits").bitwiseAND(F.lit((1 << RARE) - 1))) / F.col("rare")).alias("best"))
    found = near.where((F.col("bits") >= 1 << RARE) & (F.col("best") >= share)).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("best").alias("best"))

    base = seen.select("row", "doc_id", "n_words", *(phrase_starts(p).alias(k) for k, p in BASE.items()))
    every = F.concat(*BASE)
    base = base.select("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                       F.array_compact(F.array(*(F.when(F.size(k) > 0, F.lit(k)) for k in sorted(BASE)))).alias("base"))
    out = base.join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
