"""Licence scans: normalised text against licence templates by Dice over word bigrams.

Compared are the whole text of a document (unit 0) and each of its lines (units
from 1). Normalising keeps ASCII letters and digits in lower case and makes one
space of everything between. With A and B the sets of word bigrams, a pair
reaches a Dice of t only if the smaller set has at least t / (2 - t) of the
larger one's size, so a unit is compared with the templates within these bounds
and with no other; most units have none.

The templates are a fixed list inside the expression, so the scan is one
projection over the documents: no shuffle, no join, no Python.

Defined results: a null or empty text has no units; a unit of fewer than two words
has no bigrams and matches nothing; a one-line document can match as unit 0
and as unit 1; equal scores are all returned; repeated rows are scanned each.
Other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# Notices of public licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _bigrams_of(notice: str) -> list[str]:
    words = re.sub("[^A-Za-z0-9]+", " ", notice).lower().split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def _size_bounds(sizes: list[int], least: float) -> tuple[int, int]:
    """The smallest and largest number of bigrams that any template can match."""
    ratio = least / (2 - least)
    fits = lambda n: any(min(n, s) >= ratio * max(n, s) - 1e-9 for s in sizes)
    found = [n for n in range(1, 2 * max(sizes) + 2) if fits(n)]
    return found[0], found[-1]


def scan(docs: DataFrame, least: float = LEAST_DICE, templates=TEMPLATES) -> DataFrame:
    """(doc_id, unit, license, template, dice) for each unit and template with Dice >= ``least``."""
    grams = [_bigrams_of(t) for _, t in templates]
    low, high = _size_bounds([len(g) for g in grams], least)
    ratio = least / (2 - least)
    known = F.array(*(
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(len(g)).alias("size"),
                 F.array(*map(F.lit, g)).alias("grams"))
        for i, ((name, _), g) in enumerate(zip(templates, grams))))

    clean = F.lower(F.regexp_replace("text", r"[^A-Za-z0-9\n]+", " "))
    lines = docs.select("doc_id", F.split(clean, "\n").alias("lines"))
    whole = F.array_join(F.col("lines"), " ")
    units = lines.select("doc_id", F.posexplode(F.concat(F.array(whole), F.col("lines"))).alias("unit", "text"))
    # n words have at most n - 1 bigrams and n characters at most n / 2 words: short units leave before they are cut
    units = units.filter(F.length("text") >= 2 * low + 1).select("doc_id", "unit", _words(F.col("text")).alias("words"))
    units = units.filter(F.size("words") > low).select("doc_id", "unit", _bigrams(F.col("words")).alias("grams"))
    units = units.filter(F.size("grams").between(low, high))

    def near(t: Column) -> Column:
        n = F.size("grams")
        return F.least(n, t["size"]) >= ratio * F.greatest(n, t["size"]) - 1e-9

    def compared(t: Column) -> Column:
        shared = F.size(F.array_intersect("grams", t["grams"]))
        return F.struct(t["license"].alias("license"), t["template"].alias("template"),
                        (2.0 * shared / (F.size("grams") + t["size"])).alias("dice"))

    hits = F.filter(F.transform(F.filter(known, near), compared), lambda h: h["dice"] >= least)
    return units.select("doc_id", "unit", F.explode(hits).alias("hit")).select("doc_id", "unit", "hit.*")


def oracle_sql(least: float = LEAST_DICE, templates=TEMPLATES) -> str:
    rows = ", ".join(f"({i}, '{name}', '{notice.replace(chr(39), chr(39) * 2)}')" for i, (name, notice) in enumerate(templates))
    words = "list_filter(string_split(lower(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    bigrams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    return f"""
WITH t AS (SELECT template, license, {bigrams} AS tg FROM
  (SELECT col0 AS template, col1 AS license, {words.format('col2')} AS words FROM (VALUES {rows}))),
bounds AS (SELECT max(len(tg)) AS most FROM t),
u AS (SELECT doc_id, 0 AS unit, text AS line FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest(range(1, len(ls) + 1)), unnest(ls) FROM
  (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, unit, {words.format('line')} AS words FROM u),
g AS (SELECT doc_id, unit, {bigrams} AS ug FROM w WHERE len(words) > 1),
s AS (SELECT doc_id, unit, license, template, len(list_intersect(ug, tg)) AS shared, len(ug) + len(tg) AS total
  FROM g JOIN t ON len(ug) <= 2 * (SELECT most FROM bounds) AND list_has_any(ug, tg))
SELECT doc_id, CAST(unit AS INTEGER) AS unit, license, CAST(template AS INTEGER) AS template,
       2.0::DOUBLE * shared / total AS dice FROM s WHERE 2.0::DOUBLE * shared / total >= {least}"""
