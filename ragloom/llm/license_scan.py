"""License scan: lines and paragraphs against license templates by Dice over word bigrams.

A-Z is lower-cased and words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Units are
the lines of a text and its paragraphs (cut at blank lines; without any, the
whole text). The coefficient is taken over distinct bigrams. A template is a
candidate only where the sizes allow the threshold: from t / (2 - t) of its size
to (2 - t) / t. Only SQL functions are used, and nothing is shuffled.

Null and empty texts have no units that match. A unit that reaches the
threshold with several templates goes to the highest coefficient, then the name
first in order, then the template first in the list. Repeated rows are reported
as often as they occur.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.common import table
from ragloom.llm.registry import query

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices by which works commonly name their license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@dataclass(frozen=True)
class LicenseParams:
    threshold: float = 0.85


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a template, by the word rule above."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in text)
    words = low.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), NO_WORD, " ")
    return F.split(F.trim(plain), " ")


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams with which a text can reach the threshold against ``size``.

    2 min(a, b) / (a + b) is the most that sizes allow.
    """
    sizes = range(1, 2 * int(size / threshold) + 2)
    fit = [a for a in sizes if 2.0 * min(a, size) / (a + size) >= threshold]
    return fit[0], fit[-1]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, params: LicenseParams = LicenseParams(),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units that carry a license: id, kind ("line", "paragraph"), unit (from 0), license, dice, unit_text."""
    known = [(n, name, b) for n, (name, text) in enumerate(templates) if (b := bigrams_of(text))]
    every = sorted({x for _, _, b in known for x in b})
    # a match shares at least threshold / (2 - threshold) of the smallest template's bigrams
    least = min((bounds(len(b), params.threshold)[0] for _, _, b in known), default=1)
    text = docs[text_col].cast("string")

    def units(kind: str, at: Column) -> Column:
        return F.transform(at, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("unit"), u.alias("unit_text"), words(u).alias("words")))

    both = F.concat(units("line", F.split(text, "\n")), units("paragraph", F.split(text, r"\n[ \t\r]*\n")))
    rows = docs.select(docs[id_col].alias("id"), F.inline(both))
    # each explode fixes a column, so that no expression is computed twice
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.select("id", "kind", "unit", "unit_text", F.explode(F.array(pairs)).alias("bigrams"))
    shared = F.filter("bigrams", lambda x: x.isin(every))
    rows = rows.filter(F.size(shared) >= least) if every else rows.filter(F.lit(False))
    distinct = F.array_distinct(F.filter("bigrams", lambda x: x.isNotNull()))
    rows = rows.select("id", "kind", "unit", "unit_text", F.explode(F.array(distinct)).alias("a"))

    def against(n: int, name: str, b: list[str]) -> Column:
        lo, hi = bounds(len(b), params.threshold)
        both = F.size(F.array_intersect("a", F.array(*[F.lit(x) for x in b])))
        dice = (F.lit(2.0) * both) / (F.size("a") + len(b))
        found = F.struct((-dice).alias("less"), F.lit(name).alias("license"), F.lit(n).alias("place"))
        return F.when(F.size("a").between(lo, hi) & (dice >= params.threshold), found)

    best = F.array_min(F.array(*[against(*t) for t in known])) if known else F.lit(None).cast("struct<less:double,license:string,place:int>")
    rows = rows.select("id", "kind", "unit", "unit_text", F.explode(F.array(best)).alias("best")).filter("best IS NOT NULL")
    return rows.select(F.col("id").alias(id_col), "kind", "unit", F.col("best.license").alias("license"), (-F.col("best.less")).alias("dice"), "unit_text")


def oracle() -> str:
    rows = ", ".join(f"({n}, '{name}', [{', '.join(repr(x) for x in bigrams_of(text))}])" for n, (name, text) in enumerate(TEMPLATES))
    return rf"""
    WITH t(place, license, b) AS (VALUES {rows}),
    u AS (
        SELECT doc_id, 'line' AS kind, i - 1 AS unit, s[i] AS u
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)
        UNION ALL
        SELECT doc_id, 'paragraph', i - 1, s[i]
        FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS s FROM documents), unnest(range(1, len(s) + 1)) AS r(i)),
    w AS (
        SELECT doc_id, kind, unit,
               regexp_extract_all(translate(u, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM u),
    a AS (
        SELECT doc_id, kind, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a
        FROM w WHERE len(w) > 1),
    d AS (SELECT doc_id, kind, unit, license, place, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM a, t WHERE list_has_any(a, b))
    SELECT doc_id, kind, unit, license, dice FROM d WHERE dice >= {LicenseParams().threshold}
    QUALIFY row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, license, place) = 1
    """


@query(oracle())
def op1_license_scan(spark, sf_dir):
    """License notices in the lines and paragraphs of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("unit_text")
