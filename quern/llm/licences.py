"""Operator 6, licence scans: Dice coefficient over word bigrams against licence templates.

Lines, and paragraphs of several lines, are normalised to lower-case words of
letters and digits and compared with templates as sets of word bigrams:
``2 * common / (a + b)``. Two exact bounds keep most of the corpus out. Sizes:
a segment can only reach the threshold t if its bigrams number between
``t / (2 - t)`` and ``(2 - t) / t`` times the template's. Anchors: every
template has a few words such that without any of them too few of its bigrams
are left, so a segment has to hold an anchor word of the template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence statements and notices as they are written.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_common(size: int, threshold: float) -> int:
    """The fewest bigrams that a segment of any allowed size shares with a template of ``size`` bigrams."""
    smallest = math.ceil(threshold / (2 - threshold) * size - 1e-9)
    return math.ceil(threshold * (size + smallest) / 2 - 1e-9)


def anchors_of(text: str, threshold: float) -> list[str]:
    """Words, longest first, without which fewer bigrams are left than any match needs."""
    left = set(bigrams_of(text))
    need, chosen = least_common(len(left), threshold), []
    for word in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        chosen.append(word)
        left = {b for b in left if word not in b.split(" ")}
    return chosen


def template_array(threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """The templates as one constant: licence, anchors, grams and the sizes that may match."""
    rows = []
    for licence, text in templates:
        grams = bigrams_of(text)
        low = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        high = math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
        rows.append(
            F.struct(
                F.lit(licence).alias("licence"),
                F.array(*map(F.lit, anchors_of(text, threshold))).alias("anchors"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.lit(low).alias("low"),
                F.lit(high).alias("high"),
            )
        )
    return F.array(*rows)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def scan_licences(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per matching segment and licence: id, segment (``line`` or ``paragraph``), number (from 0), licence and dice.

    Lines are cut at newlines, paragraphs at empty lines; a paragraph of one
    line is a line. Of the templates of a licence the best counts. Null and
    empty texts match nothing; repeated rows give repeated results. An empty
    table gives no rows; other columns are ignored. Whole texts are searched.
    """
    anchors = sorted({a for _, text in templates for a in anchors_of(text, threshold)})
    anchor_list = F.array(*map(F.lit, anchors))
    names = F.array(*map(F.lit, sorted({licence for licence, _ in templates})))
    hopeful = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        F.arrays_overlap(_words(F.col("text")), anchor_list)
    )

    def cut(kind: str, pieces: Column) -> Column:
        return F.transform(
            pieces, lambda p, i: F.struct(F.lit(kind).alias("segment"), i.alias("number"), p.alias("part"))
        )

    paragraphs = F.filter(F.split("text", "\n[\\x20\\x09]*\n"), lambda p: F.contains(p, F.lit("\n")))
    pieces = F.concat(cut("line", F.split("text", "\n")), cut("paragraph", paragraphs))
    parts = hopeful.select("id", F.inline(pieces)).select("id", "segment", "number", _words(F.col("part")).alias("words"))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))
    )
    parts = parts.filter((F.size("words") > 1) & F.arrays_overlap("words", anchor_list)).select(
        "id", "segment", "number", "words", F.array_distinct(grams).alias("grams")
    )
    size = F.size("grams")

    def score(t: Column) -> Column:
        possible = (size >= t["low"]) & (size <= t["high"]) & F.arrays_overlap(F.col("words"), t["anchors"])
        dice = F.size(F.array_intersect(F.col("grams"), t["grams"])) * F.lit(2.0) / (size + F.size(t["grams"]))
        return F.struct(t["licence"].alias("licence"), F.when(possible, dice).otherwise(F.lit(0.0)).alias("dice"))

    parts = parts.select("id", "segment", "number", F.transform(template_array(threshold, templates), score).alias("scores"))

    def best(name: Column) -> Column:
        own = F.transform(F.filter("scores", lambda s: s["licence"] == name), lambda s: s["dice"])
        return F.struct(name.alias("licence"), F.array_max(own).alias("dice"))

    return (
        parts.select("id", "segment", "number", F.inline(F.transform(names, best)))
        .filter(F.col("dice") >= threshold - 1e-12)
        .select(F.col("id").alias(id_col), "segment", "number", "licence", F.round("dice", 9).alias("dice"))
    )


def oracle(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for the same rows, without any pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(licence)}, {n}, {quoted(text)})" for n, (licence, text) in enumerate(templates))
    return f"""
WITH given(licence, template, text) AS (VALUES {values}),
pieces AS (
  SELECT doc_id, 'line' AS segment, unnest(range(len(l))) AS number, unnest(l) AS part
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(range(len(l))), unnest(l)
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda p: contains(p, chr(10))) AS l
        FROM documents WHERE text IS NOT NULL)
),
segments AS (SELECT row_number() OVER () AS s, * FROM pieces),
cut AS (
  SELECT 0 AS kind, s AS key, list_filter(regexp_split_to_array(lower(part), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM segments
  UNION ALL
  SELECT 1, template, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') FROM given
),
grams AS (
  SELECT DISTINCT kind, key, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT kind, key, w, unnest(range(1, len(w))) AS i FROM cut WHERE len(w) > 1)
),
sizes AS (SELECT kind, key, count(*) AS n FROM grams GROUP BY ALL),
common AS (
  SELECT a.key AS s, b.key AS template, count(*) AS n
  FROM grams a JOIN grams b ON a.g = b.g WHERE a.kind = 0 AND b.kind = 1 GROUP BY ALL
),
scored AS (
  SELECT c.s, g.licence, max(2.0::DOUBLE * c.n / (x.n + y.n)) AS dice
  FROM common c JOIN sizes x ON x.kind = 0 AND x.key = c.s JOIN sizes y ON y.kind = 1 AND y.key = c.template
  JOIN given g ON g.template = c.template GROUP BY ALL
)
SELECT s.doc_id, s.segment, s.number::INTEGER AS number, c.licence, round(c.dice, 9) AS dice
FROM scored c JOIN segments s ON s.s = c.s WHERE c.dice >= {threshold} - 1e-12
"""
