"""Licence scans: lines and paragraphs compared with licence templates by the Dice coefficient of word bigrams.

Texts are normalised: A-Z in lower case, every run of other characters than letters a-z, digits and line feeds
becomes one blank. The units are lines, paragraphs (between blank lines) of more than one line, and the distinct sentences that are
no whole line. With ``a`` and ``b``
distinct bigrams, a coefficient of at least ``t`` needs ``t / (2 - t) <= a / b <= (2 - t) / t``: the words of a
unit are counted first, units that fit no template are not cut into bigrams, and units that share no bigram with any
template are compared with none.

A match also shares at least ``t / (2 - t)`` of a template's bigrams. So if a few words stand in more than the rest of every template's
bigrams, a text or unit without any of those words matches nothing (``anchors``), and is not even normalised.

All of it happens inside the row with DataFrame functions, so there is no shuffle, no key that could be hot, and
repeated rows give equal rows. Null and empty texts match nothing; a null doc_id is kept. Of equal coefficients the
template that comes first counts. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Licence, and a text by which it is declared.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, in order."""
    words = "".join(c if c in LOWER + "0123456789" else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(known: list[list[str]], threshold: float) -> list[str]:
    """Words of which every match holds at least one.

    A template with ``b`` bigrams shares ``t b / (2 - t)`` of them with whatever matches it, so one of any ``b`` less that plus one
    occurs. Words are added, those first that stand in most bigrams still needed, until they stand in so many of each template.
    """
    need = [len(b) - math.ceil(threshold * len(b) / (2 - threshold) - 1e-9) + 1 for b in known]
    open_ = [[set(b.split()) for b in bigrams] for bigrams in known]
    chosen: list[str] = []
    while any(n > 0 for n in need):
        gain: dict[str, int] = {}
        for n, bigrams in zip(need, open_, strict=True):
            for word in sorted({w for b in bigrams for w in b}) if n > 0 else ():
                gain[word] = gain.get(word, 0) + min(n, sum(word in b for b in bigrams))
        word = max(gain, key=lambda w: (len(w) >= 5, gain[w], w))  # short words are common in any text
        chosen.append(word)
        for k, bigrams in enumerate(open_):
            left = [b for b in bigrams if word not in b]
            need[k] -= len(bigrams) - len(left)
            open_[k] = left
    return chosen


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), r"[^a-z0-9\n]+", " ")


def sentences(text: Column) -> Column:
    """The text with a line feed behind each sentence."""
    return F.regexp_replace(text, r"[.!?;]+[ \t]+", "\n")


def _bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def find_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, matches``: an array of (unit, licence, template, dice), one for each unit that matches a template.

    ``unit`` is the unit's place (lines first, then paragraphs, from 0), ``template`` the place in ``templates`` of
    the best one.
    """
    known = [(licence, template_bigrams(text)) for licence, text in templates]
    sizes = [len(b) for _, b in known]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    every = F.array(*(F.lit(b) for b in dict.fromkeys(b for _, bigrams in known for b in bigrams)))
    words = anchors([b for _, b in known], threshold)
    # Lower case of other letters may add a word, but never takes one away.
    holds = lambda text: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])
    text = normalised(F.col("text"))
    paragraphs = F.filter(F.split(text, r"\n ?(?:\n ?)+"), lambda p: F.contains(F.trim(F.translate(p, "\n", " ")), F.lit(" ")) & F.contains(p, F.lit("\n")))
    lines, parts = (F.transform(F.split(x, "\n"), lambda u: F.trim(u)) for x in (text, normalised(sentences(F.col("text")))))
    units = F.concat(lines, F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, r"[ \n]+", " "))), F.array_except(parts, lines))
    units = F.transform(units, lambda u, i: F.struct(i.alias("unit"), u.alias("words")))
    # Words are parted by single blanks; a unit has at least as many distinct bigrams as a template needs, or none fits.
    count = lambda u: F.length(u["words"]) - F.length(F.translate(u["words"], " ", ""))
    units = F.filter(units, lambda u: (count(u) >= low * min(sizes)) & holds(u["words"]))
    cut = F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("bigrams")))
    shared = F.filter(cut, lambda u: (F.size(u["bigrams"]) <= high * max(sizes)) & F.arrays_overlap(u["bigrams"], every))

    def best(u: Column) -> Column:
        found = []
        for place, (licence, bigrams) in enumerate(known):
            n = F.size(u["bigrams"])
            fits = (n >= low * len(bigrams)) & (n <= high * len(bigrams))
            common = F.size(F.array_intersect(u["bigrams"], F.array(*map(F.lit, bigrams))))
            dice = F.when(fits, 2.0 * common / (n + len(bigrams))).otherwise(0.0)
            found.append(F.struct(dice.alias("dice"), F.lit(-place).alias("place"), F.lit(licence).alias("licence")))
        return F.struct(u["unit"].alias("unit"), F.array_max(F.array(*found)).alias("best"))

    matches = F.filter(F.transform(shared, best), lambda u: u["best"]["dice"] >= threshold)
    flat = F.transform(
        matches,
        lambda u: F.struct(
            u["unit"].alias("unit"), u["best"]["licence"].alias("licence"), (-u["best"]["place"]).alias("template"), u["best"]["dice"].alias("dice")
        ),
    )
    none = F.array().cast("array<struct<unit:int,licence:string,template:int,dice:double>>")
    return docs.select("doc_id", F.when(holds(F.lower("text")), flat).otherwise(none).alias("matches"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by joins of unnested units, for every document: matches, licences and the best coefficient."""
    rows = ", ".join(f"({place}, '{licence}', {template_bigrams(text)!r})" for place, (licence, text) in enumerate(templates))
    return f"""
WITH t(place, licence, bigrams) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS body FROM documents),
lines AS (SELECT DISTINCT doc_id, trim(unnest(string_split(body, chr(10)))) AS u FROM d),
units AS (
  SELECT doc_id, 'l' AS level, unnest(string_split(body, chr(10))) AS u, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM d
  UNION ALL
  SELECT doc_id, 'p', regexp_replace(p, '[ \\n]+', ' ', 'g'), i FROM (
    SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
    FROM (SELECT doc_id, regexp_split_to_array(body, '\\n ?(?:\\n ?)+') AS ps FROM d WHERE body LIKE '%' || chr(10) || '%'))
  WHERE contains(p, chr(10)) AND contains(trim(translate(p, chr(10), ' ')), ' ')
  UNION ALL
  SELECT doc_id, 's', u, 0 FROM (
    SELECT DISTINCT doc_id, trim(unnest(string_split(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[.!?;]+[ \t]+', chr(10), 'g'), '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)))) AS u
    FROM documents) s
  WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = s.doc_id AND l.u = s.u)),
words AS (SELECT doc_id, level, i, CASE level WHEN 's' THEN u ELSE '' END AS u, string_split(trim(u), ' ') AS w FROM units WHERE contains(trim(u), ' ')),
cut AS (
  SELECT doc_id, level, i, u, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS bigrams
  FROM words),
scored AS (
  SELECT doc_id, level, i, u, t.place, t.licence, 2.0 * len(list_intersect(cut.bigrams, t.bigrams)) / (len(cut.bigrams) + len(t.bigrams)) AS dice
  FROM cut, t),
best AS (
  SELECT * FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, level, i, u ORDER BY dice DESC, place) = 1),
found AS (
  SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(dice) AS best_dice
  FROM best GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences, round(best_dice, 6) AS best_dice
FROM documents d LEFT JOIN found USING (doc_id)
"""
