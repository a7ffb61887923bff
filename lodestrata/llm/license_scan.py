"""Operator 6: license scans by an exact set-similarity join.  Native expressions only.

Templates and text blocks are sets of words.  Blocks are runs of consecutive lines, half of each shared with the next, in
lengths that fit the templates, so a notice is found however its lines are wrapped.  A block meets a template where it holds
at least THRESHOLD of the template's words (containment).  Words are ordered by how often blocks hold them, rarest first; a
block that meets the template shares a word of both prefixes in that order with it (prefix filter), has at least `need` template
words (length filter), and the first word that both prefixes hold leaves enough words after it in the template and in the block
(positional filter).  Only pairs that pass are counted out.  The text is read once; documents without any word of the
templates' prefixes make no blocks, and none is compared with all templates.  The templates' words are a fixed, small set, so the join
side that is broadcast has a proven bound.
"""

from __future__ import annotations

import collections
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import load, materialize

#: Fixed phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Templates of the method, fixed values: a label and the text of a license, of its notice, or of a one-line statement.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
        that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If
        not, see <https://www.gnu.org/licenses/>."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
        OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
]
THRESHOLD = 0.8
#: Lengths of blocks in lines.  A block starts at every half length, so a run of up to half a length and one line lies in one.
BLOCK_LINES = (2, 8, 64)
#: Words that a wrapped line holds at least, by which a template's lines are reckoned.
LINE_WORDS = 7
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in _UPPER else c for c in text))))


def block_lines(text: str) -> int:
    """The block length whose blocks hold a template whole when it is wrapped into lines of LINE_WORDS words or more."""
    lines = 1 + math.ceil(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)) / LINE_WORDS)
    return next((n for n in BLOCK_LINES if n // 2 + 1 >= lines), BLOCK_LINES[-1])


def _phrase(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, the base columns, `_hit` (labels found by phrase) and `_held` (see _line_words).

    Null texts are empty; a text without words has n_words 0.  Native string search: nothing is shuffled.
    """
    rows = documents.select(*[F.col(c) for c in keep], F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER).alias("_lower"))
    # every word stands between two spaces of its own, so that fixed phrases are found by plain string search
    rows = rows.select("*", F.btrim(F.regexp_replace("_lower", _GAP, "  ")).alias("_words"))
    rows = rows.select(*keep, _line_words(F.col("_lower"), F.split("_words", "  ")).alias("_held"), F.when(F.col("_words") == "", "").otherwise(F.concat(F.lit(" "), "_words", F.lit(" "))).alias("_t"))
    t = F.col("_t")
    n_words = F.when(t == "", 0).otherwise(_spaces(t) / 2).cast("long")
    places = [((F.length(t) - F.length(F.replace(t, F.lit(_phrase(p)), F.lit("")))) / len(_phrase(p))).cast("long") for p, _ in PHRASES]
    rows = rows.select(*keep, "_t", "_held", n_words.alias("n_words"), F.array(*places).alias("_places"))
    first = F.least(*[F.when(F.col("_places")[i] > 0, _spaces(F.substring_index(t, _phrase(p), 1)) / 2) for i, (p, _) in enumerate(PHRASES)])
    last = F.greatest(*[F.when(F.col("_places")[i] > 0, F.col("n_words") - _spaces(F.substring_index(t, _phrase(p), -1)) / 2 - len(p.split())) for i, (p, _) in enumerate(PHRASES)])
    labels = F.array_compact(F.array(*[F.when(F.col("_places")[i] > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    return rows.select(
        *keep, "n_words", F.aggregate("_places", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_base"),
        first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("_hit"), "_held",
    )


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _line_words(lower: Column, words: Column) -> Column:
    """Of each line, the distinct words that templates hold; null where the whole text holds too few of these, or none of the words
    that a match must hold one of (see `probes`)."""
    vocabulary = _literals(sorted({w for _, text in TEMPLATES for w in template_words(text)}))
    held = F.transform(F.split(lower, "\n", -1), lambda x: F.array_intersect(vocabulary, F.split(x, _GAP)))
    least = min(least_need(n) for n in BLOCK_LINES if any(block_lines(text) == n for _, text in TEMPLATES))
    # let-binding: an array of one element, so that the words are looked up once
    return F.get(F.transform(F.array(F.array_intersect(vocabulary, words)), lambda found: F.when((F.size(found) >= least) & F.arrays_overlap(found, _literals(probes())), held)), 0)


def probes() -> list[str]:
    """The prefixes of all templates in an order that is known before texts are: words of fewest templates first, then longer words.

    Prefixes of any one order do, and a text that meets a template holds a word of its prefix.
    """
    in_templates = collections.Counter(w for _, text in TEMPLATES for w in template_words(text))
    out = set()
    for _, text in TEMPLATES:
        words = sorted(template_words(text), key=lambda w: (in_templates[w], -len(w), w))
        out.update(words[: len(words) - _need(len(words)) + 1])
    return sorted(out)


def _blocks(held: Column) -> Column:
    """Blocks of all lengths: (lines, words), the words distinct; those with too few words for any template of that length go."""

    def of_length(lines: int) -> Column:
        least = least_need(lines)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(held) - 1 - lines // 2), F.lit(lines // 2))
        words = F.transform(starts, lambda i: F.array_distinct(F.flatten(F.slice(held, i + 1, lines))))
        return F.transform(F.filter(words, lambda w: F.size(w) >= least), lambda w: F.struct(F.lit(lines).alias("lines"), w.alias("words")))

    return F.concat(*[of_length(n) for n in sorted({block_lines(text) for _, text in TEMPLATES})])


def _need(size: int) -> int:
    return math.ceil(THRESHOLD * size - 1e-9)


def least_need(lines: int) -> int:
    """The fewest words that any template of a block length needs."""
    return min(_need(len(template_words(text))) for _, text in TEMPLATES if block_lines(text) == lines)


def template_frame(spark: SparkSession) -> DataFrame:
    """(template, label, lines, word): bounded by TEMPLATES, about a thousand rows."""
    rows = [(i, label, block_lines(text), w) for i, (label, text) in enumerate(TEMPLATES) for w in template_words(text)]
    return spark.createDataFrame(rows, "template int, label string, lines int, word string")


def candidates(rows: DataFrame) -> DataFrame:
    """(_row, label, words, ordered, size, need, held, position, place): a pair of a text block (_row, lines, words) and a template of
    its length for each word that the prefixes of both hold.

    The global order is rarest first, by the blocks that hold a word, ties by the word.  A block that meets a template shares `need`
    words with it, so the first of these in the order is among the first size - need + 1 of the template and among the first
    held - least + 1 of the block, where `held` is the block's number of template words and `least` the smallest need of its
    length.  `position` and `place` are where the word stands in the template's and in the block's order.
    """
    templates = template_frame(rows.sparkSession)
    counted = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    ranked = templates.join(F.broadcast(counted), "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # a row for each word of TEMPLATES
    order = [r.word for r in ranked.select("freq", "word").distinct().orderBy("freq", "word").collect()]
    whole = ranked.groupBy("template", "label", "lines").agg(F.array_sort(F.collect_list(F.struct("freq", "word"))).alias("ordered"))
    whole = whole.select("template", "label", "lines", F.size("ordered").alias("size"), F.ceil(F.size("ordered") * THRESHOLD - 1e-9).cast("int").alias("need"), F.col("ordered.word").alias("ordered"))
    prefix = whole.select("*", F.posexplode(F.slice("ordered", F.lit(1), F.col("size") - F.col("need") + 1)).alias("position", "word"))
    least = F.create_map(*[F.lit(x) for n in sorted({block_lines(t) for _, t in TEMPLATES}) for x in (n, least_need(n))])
    # an intersection keeps the order of its first array
    placed = rows.select("_row", "lines", F.array_intersect(_literals(order), "words").alias("words")).withColumn("held", F.size("words"))
    tokens = placed.select("*", F.posexplode(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.col("held") - least[F.col("lines")] + 1))).alias("place", "word"))
    return tokens.join(F.broadcast(prefix), ["lines", "word"])


def long_enough(pairs: DataFrame) -> DataFrame:
    """Length filter: the block holds as many template words as the template needs."""
    return pairs.where(F.col("held") >= F.col("need"))


def can_reach(pairs: DataFrame) -> DataFrame:
    """Positional filter: this word and all that follow it in either order are enough."""
    return pairs.where(F.least(F.col("size") - F.col("position"), F.col("held") - F.col("place")) >= F.col("need"))


def matches(rows: DataFrame) -> DataFrame:
    """(_row, label, score): every text block of `rows` (_row, lines, words) that meets a template, the best score per label."""
    pairs = can_reach(long_enough(candidates(rows)))
    # of the words that both prefixes hold, only the first one makes the pair
    first = F.size(F.array_intersect(F.slice("ordered", F.lit(1), F.col("position")), "words")) == 0
    pairs = pairs.where(first).withColumn("shared", F.size(F.array_intersect("ordered", "words"))).where("shared >= need")
    return pairs.groupBy("_row", "label").agg(F.max(F.col("shared") / F.col("size")).alias("score"))


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """One row per document with the base columns, `labels` and `score`.

    Very long texts are handled like others, line by line; a text without line breaks is one line.
    `score` is the highest containment of any template, 1 where a phrase stands, 0 where nothing is found.  Rows are told
    apart by their place in the input, so repeated rows and null ids are rows like any other.
    """
    base = materialize(base_scan(documents, keep).withColumn("_row", F.monotonically_increasing_id()), "license-rows")
    blocks = base.where("_held is not null").select("_row", F.explode(_blocks(F.col("_held"))).alias("x")).select("_row", "x.lines", "x.words")
    found = matches(materialize(blocks, "license-blocks"))
    found = found.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    rows = base.drop("_held").join(found, "_row", "left")
    return rows.select(
        *keep, "n_words", "n_base", "first_word", "last_word", F.array_join("_hit", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_hit", F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"), ["doc_id"])


def _sql_words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SQL_PLACES = " UNION ALL ".join(f"SELECT rid, i - 1 AS i, '{label}' AS label FROM pos WHERE ws[i:i + {len(p.split()) - 1}] = {_sql_words(p.split())}" for p, label in PHRASES)
_SQL_TEMPLATES = ", ".join(f"('{label}', {block_lines(text)}, {_sql_words(template_words(text))})" for label, text in TEMPLATES)
_SQL_LENGTHS = ", ".join(f"({n})" for n in BLOCK_LINES)
_SQL_WORDS = r"regexp_extract_all(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, {_SQL_WORDS % "t"} AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hits AS ({_SQL_PLACES}),
h AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY rid),
l AS (SELECT rid, string_split(t, chr(10)) AS lines FROM d),
b AS (SELECT rid, n, lines, unnest(range(0, greatest(1, len(lines) - n // 2), n // 2)) AS i FROM l CROSS JOIN (VALUES {_SQL_LENGTHS}) AS v(n)),
x AS (SELECT rid, n, list_distinct({_SQL_WORDS % "array_to_string(lines[i + 1:i + n], chr(10))"}) AS ws FROM b),
m AS (SELECT rid, label, len(list_intersect(ws, tw)) / len(tw) AS score FROM x JOIN (VALUES {_SQL_TEMPLATES}) AS v(label, n, tw) USING (n)),
g AS (SELECT rid, list(DISTINCT label) AS labels, max(score) AS score FROM m WHERE score >= {THRESHOLD} - 1e-9 GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(h.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(h.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(g.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN h USING (rid) LEFT JOIN g USING (rid)
"""
