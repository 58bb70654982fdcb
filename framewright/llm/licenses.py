r"""Licence scans: normalised lines and texts compared with templates by Dice coefficient over word bigrams.

Units are every line of a text, every 2 to ``WINDOW`` lines in a row of at most ``WRAPPED`` characters (a notice may
be wrapped), every sentence of as many characters (it may stand in a line of prose) and the whole text (of whole
licences).  Normalising lower-cases and turns every run of
characters outside a-z and 0-9 into one space.  With |A| and |B| the numbers of distinct bigrams of a
unit and a template, Dice is ``2 |A & B| / (|A| + |B|)``; a unit counts for its best template of at
least ``threshold``, the first by name among equals.

Pruning is exact.  By size: Dice can reach ``threshold`` only if ``2 min(|A|, |B|) >= threshold
(|A| + |B|)``, and |A| is at most a unit's words less one and at least 1, so units whose words are too
few for every template never form bigrams, nor do pairs of wrong sizes.  By words: such a unit shares at
least ``needed(B)`` bigrams of the template, so it has one of a set of words whose bigrams leave fewer
than that many others.

There is no shuffle and no Python; work follows the length of the texts.  Null text counts as empty and
has no matches; repeated rows give repeated results; an empty table gives none; templates of fewer than
two words match nothing; other columns pass through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.columns import fresh
from framewright.llm.pii import let

THRESHOLD = 0.8

# Common licence notices, by identifier.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: The most lines that a wrapped notice is looked for in, and the most characters of those and of a sentence:
#: over twice the longest notice.
WINDOW, WRAPPED = 4, 400
SENTENCE_END = "[.!?][ \n]+"


def normalised_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed(size: int, threshold: float) -> int:
    """Bigrams that any unit must share with a template of ``size`` bigrams to reach the threshold.

    Dice >= t needs 2 s >= t (size + |A|) and |A| >= s, so s >= t size / (2 - t)."""
    return max(1, math.ceil(threshold * size / (2 - threshold) - 1e-9))


def telling_words(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every matching unit has one: for each template, long words first until the
    bigrams without any of them are too few."""
    chosen: set[str] = set()
    for grams in templates.values():
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w))
        own: set[str] = set()
        for w in words:
            if sum(not own & set(g.split()) for g in grams) < needed(len(grams), threshold):
                break
            own.add(w)
        chosen |= own
    return sorted(chosen)


def _words(unit: Column) -> Column:
    lower = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def units_of(text: Column, hint: str) -> Column:
    """The units of a text that have a telling word.  Runs of lines are only built about lines that have one."""

    def in_lines(rated: Column) -> Column:
        telling = F.filter(rated, lambda r: r.hint)

        def runs(n: int) -> Column:
            joined = lambda i: F.when(F.exists(F.slice(rated, i, F.lit(n)), lambda r: r.hint), F.array_join(F.transform(F.slice(rated, i, F.lit(n)), lambda r: F.substring(r.line, 1, WRAPPED + 1)), "\n"))
            all_ = F.when(F.size(rated) >= n, F.transform(F.sequence(F.lit(1), F.size(rated) - (n - 1)), joined)).otherwise(F.array().cast("array<string>"))
            return F.filter(all_, lambda u: F.char_length(u) <= WRAPPED)

        sentences = F.filter(F.split(text, SENTENCE_END), lambda u: (F.char_length(u) <= WRAPPED) & u.rlike(hint))
        return F.concat(F.transform(telling, lambda r: r.line), *(runs(n) for n in range(2, WINDOW + 1)), sentences, F.array(text))

    return let(F.transform(F.split(text, "\n"), lambda u: F.struct(u.alias("line"), u.rlike(hint).alias("hint"))), in_lines)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", name: str = "licences") -> DataFrame:
    """``docs`` with an array column ``name`` of (template, dice), one for every distinct matching unit; raises if
    they have such a column."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    known = {k: g for k, t in sorted(templates.items()) if (g := bigrams_of(normalised_words(t)))}
    none = F.array().cast("array<struct<template: string, dice: double>>")
    if not known:
        return docs.withColumn(name, none)
    listed = F.array(*(F.struct(F.lit(k).alias("template"), F.array(*map(F.lit, g)).alias("grams")) for k, g in known.items()))
    least = min(needed(len(g), threshold) for g in known.values()) + 1
    hint = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, telling_words(known, threshold))) + ")"
    units, text = fresh(docs.columns, "units"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.when(text.rlike(hint), F.array_distinct(units_of(text, hint)))

    def best(words: Column) -> Column:
        def rate(grams: Column) -> Column:
            n = F.size(grams)
            bound = lambda t: 2 * F.least(n, F.size(t.grams)) >= F.lit(threshold) * (n + F.size(t.grams))
            dice = lambda t: 2.0 * F.size(F.array_intersect(grams, t.grams)) / (n + F.size(t.grams))
            rated = F.transform(F.filter(listed, bound), lambda t: F.struct((-dice(t)).alias("minus"), t.template.alias("template")))
            return F.array_min(rated)

        return F.when(F.size(words) >= least, let(_bigrams(words), rate))

    matches = F.filter(F.transform(F.col(units), lambda u: let(_words(u), best)), lambda b: b.minus <= -threshold)
    return docs.withColumn(units, found).withColumn(name, F.coalesce(F.transform(matches, lambda b: F.struct(b.template.alias("template"), (-b.minus).alias("dice"))), none)).drop(units)


def summary(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: how many units match, which templates, and the best of them."""
    found = F.col("licences")
    least = F.array_min(F.transform(found, lambda m: F.struct((-m.dice).alias("minus"), m.template.alias("template"))))
    return scan(docs, **options).select(
        id_col,
        F.size(found).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.template))), ",").alias("templates"),
        least.template.alias("best_template"),
        F.round(-least.minus, 6).alias("best_dice"),
    )


def _oracle() -> str:
    quoted = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))

    def grams(source: str, ident: str) -> str:
        return f"SELECT DISTINCT {ident}, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT {ident}, ws, unnest(range(1, len(ws))) AS i FROM {source})"

    clean = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    runs = ", ".join(f"list_transform(range(1, len(lines) - {n - 2}), lambda i: array_to_string(lines[i : i + {n - 1}], chr(10)))" for n in range(2, WINDOW + 1))
    return f"""
WITH t AS (SELECT template, {clean.format("body")} AS ws FROM (VALUES {quoted}) AS v(template, body)),
u AS (
  SELECT row_number() OVER () AS unit, doc_id, {clean.format("unit_text")} AS ws
  FROM (SELECT DISTINCT doc_id, unit_text FROM (
    SELECT doc_id, unnest(list_concat(lines, [text], list_filter(list_concat(string_split_regex(text, '[.!?][ \n]+'), {runs}), lambda u: length(u) <= {WRAPPED}))) AS unit_text
    FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))),
tg AS ({grams("t", "template")}), ug AS ({grams("u", "unit")}),
tn AS (SELECT template, count(*) AS n FROM tg GROUP BY 1), un AS (SELECT unit, count(*) AS n FROM ug GROUP BY 1),
shared AS (SELECT unit, template, count(*) AS s FROM ug JOIN tg USING (g) GROUP BY ALL),
rated AS (SELECT unit, template, 2.0::DOUBLE * s / (un.n + tn.n) AS dice FROM shared JOIN un USING (unit) JOIN tn USING (template)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY dice DESC, template) AS r FROM rated) WHERE r = 1 AND dice >= {THRESHOLD}),
m AS (SELECT doc_id, template, dice FROM best JOIN u USING (unit)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, template) AS r FROM m) WHERE r = 1),
a AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT template, ',' ORDER BY template) AS templates FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(templates, '') AS templates, top.template AS best_template, round(top.dice, 6) AS best_dice
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN top USING (doc_id)
"""


ORACLE = _oracle()
