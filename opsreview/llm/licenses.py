"""License notices in texts, with DataFrame functions only.

A text is cut into passages: sentences or lines, and paragraphs. Passages and templates are
compared by the Dice coefficient of their sets of word bigrams (lower-case words of letters and
digits). A passage can only reach the threshold with a template of a similar number of bigrams,
so size bounds prune the templates. Before texts are cut, those are left out that
lack all anchors: of b template bigrams a match shares at least b * d / (2 - d), so any
choice of more than the rest contains one that is shared.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.llm.tables import text_of

# Notices and grants as licences and public headers word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class LicenseSettings:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    dice: float = 0.8


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    """Distinct bigrams in order."""
    own = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:], strict=False)))


def anchors(settings: LicenseSettings) -> list[str]:
    """Bigrams one of which every matching passage has; those that say most, by length, are taken."""
    share = settings.dice / (2 - settings.dice)
    out: set[str] = set()
    for _, text in settings.templates:
        own = bigrams(text)
        need = len(own) - math.ceil(len(own) * share - 1e-9) + 1
        out.update(sorted(own, key=lambda x: (-len(x), x))[:need])
    return sorted(out)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(tokens: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.when(F.size(tokens) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _passages(text: Column) -> Column:
    """Lines and sentences; and paragraphs that hold more than one of them."""
    lines = F.split(F.regexp_replace(text, r"([.!?;:]) +", "$1\n"), r"\n")
    return F.array_distinct(F.concat(lines, F.split(text, r"\n[ \t]*\n")))


def scanned(documents: DataFrame, settings: LicenseSettings | None = None) -> DataFrame:
    """``doc_id, license, dice, passages``: of each document the licences that some passage matches.

    A passage counts for its best template (of several equally near ones, the first name); ``dice`` is the
    best passage's, ``passages`` how many distinct passages count. Rows that repeat an id count
    together; null and empty texts, and passages of fewer than two words, match nothing.
    """
    settings = settings or LicenseSettings()
    text = text_of()
    rows = documents.select("doc_id", text.alias("text"))
    whole = F.concat(F.lit(" "), _normal(F.col("text")), F.lit(" "))

    def any_anchor(normal: Column) -> Column:
        found = F.lit(False)
        for anchor in anchors(settings):
            found = found | F.contains(normal, F.lit(f" {anchor} "))
        return found

    # As the element of an array the text is normalised once, not once for each anchor.
    rows = rows.filter(F.exists(F.array(whole), any_anchor))
    passages = rows.select("doc_id", F.explode(_passages(F.col("text"))).alias("passage"))
    passages = passages.select("doc_id", _normal(F.col("passage")).alias("passage")).distinct()
    cut = passages.withColumn("tokens", F.split("passage", " ")).filter(F.size("tokens") > 1).withColumn("own", _bigrams(F.col("tokens")))
    d = settings.dice
    scores = []
    for name, template in settings.templates:
        own = bigrams(template)
        low, high = math.ceil(len(own) * d / (2 - d) - 1e-9), math.floor(len(own) * (2 - d) / d + 1e-9)
        dice = 2 * F.size(F.array_intersect("own", F.array(*map(F.lit, own)))) / (F.size("own") + len(own))
        scores.append(F.when(F.size("own").between(low, high), F.struct((-F.round(dice, 6)).alias("less"), F.lit(name).alias("license"))))
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    # Generated rows are filtered as they come; a filter on a plain column would score every passage anew for each use.
    met = cut.select("doc_id", F.explode(F.array(best)).alias("best")).filter(F.col("best.less") <= -d)
    return met.groupBy("doc_id", F.col("best.license").alias("license")).agg((-F.min("best.less")).alias("dice"), F.count("*").alias("passages"))


def scanned_sql(settings: LicenseSettings | None = None) -> str:
    """The same rows in DuckDB's SQL, without anchors and size bounds."""
    settings = settings or LicenseSettings()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, bigrams(text)))}])" for name, text in settings.templates)
    return rf"""
WITH templates(license, grams) AS (VALUES {values}),
cut AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(lower(passage), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS passage
  FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;:]) +', '\1' || chr(10), 'g'), chr(10))
                 || regexp_split_to_array(text, '\n[ \t]*\n')) AS passage
        FROM documents WHERE text IS NOT NULL)),
tokens AS (SELECT doc_id, passage, string_split(passage, ' ') AS w FROM cut),
grams AS (
  SELECT doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
  FROM tokens WHERE len(w) > 1),
scored AS (
  SELECT doc_id, passage, license, round(2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)), 6) AS dice
  FROM grams, templates WHERE list_has_any(own, grams)),
best AS (
  SELECT doc_id, passage, dice, license,
         row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license) AS place
  FROM scored WHERE dice >= {settings.dice})
SELECT doc_id, license, max(dice) AS dice, count(*) AS passages FROM best WHERE place = 1 GROUP BY doc_id, license"""
