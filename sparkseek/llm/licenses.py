"""License scans: MinHash bands over overlapping windows, then exact shingle containment; DataFrame functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SIMILAR = 5, 0.8
#: Words of a segment; a long text is cut into segments that overlap by the longest window.
SEGMENT = 4096
#: Greatest chance that a window which holds a template is not retrieved.
MISS = 1e-3

# Notices by license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    """The same normal form as in the plan: lower case, runs of other characters than letters and digits as spaces."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def shingles_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


@dataclass(frozen=True)
class Windows:
    """Window of a class of templates with similar numbers of shingles: ``size`` shingles from every ``step``-th."""

    least: int
    size: int
    step: int

    @property
    def bands(self) -> int:
        """Bands of one row each. A window that holds SIMILAR of a template has at least this Jaccard likeness to it."""
        held = math.ceil(SIMILAR * self.least)
        likeness = held / (self.size + self.least - held)
        return max(1, math.ceil(math.log(MISS) / math.log(1 - likeness))) if likeness < 1 else 1


def plan_windows(templates: dict[str, str]) -> dict[str, Windows]:
    """Window class of each template: any run of a template's length lies within one window of its class."""
    count = {k: len(shingles_of(words_of(t))) for k, t in templates.items()}
    if short := [k for k, n in count.items() if not n]:
        raise ValueError(f"templates need at least {SHINGLE} words: {short}")
    out = {}
    for k, n in count.items():
        peers = [m for m in count.values() if m.bit_length() == n.bit_length()]
        step = 1 << max(0, max(peers).bit_length() - 3)
        out[k] = Windows(min(peers), max(peers) + step, step)
    return out


def anchors(template: str) -> list[str]:
    """Words of which no text may lack all that holds SIMILAR of the template: together they are in more shingles than may be missing.

    One long word where that does; where no word is in so many shingles, words are added until they are.
    """
    left = [set(g.split()) for g in shingles_of(words_of(template))]
    need, out = len(left) - math.ceil(SIMILAR * len(left)) + 1, []
    while need > 0:
        held = {w: sum(w in g for g in left) for g in left for w in g}
        word = max(sorted(held), key=lambda w: (min(held[w], need), len(w)))
        out.append(word)
        need -= held[word]
        left = [g for g in left if word not in g]
    return out


def _bands(spark: SparkSession, templates: dict[str, str], planned: dict[str, Windows], ids: dict[Windows, int]) -> DataFrame:
    """``kind, band, low, license, grams``: a row for each template and band, so as few as the templates."""
    rows = [(k, ids[planned[k]], planned[k].bands, shingles_of(words_of(t))) for k, t in templates.items()]
    table = spark.createDataFrame(rows, "license string, kind int, bands int, text array<string>")
    table = table.withColumn("grams", F.transform("text", lambda t: F.xxhash64(t)))
    low = F.transform(F.sequence(F.lit(1), F.col("bands")), lambda j: F.array_min(F.transform("grams", lambda h: F.xxhash64(h, j))))
    return table.withColumn("low", low).select("license", "kind", "grams", F.posexplode("low").alias("band", "low"))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, exact: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` and license found: ``doc_id, license, containment, first_word``.

    A license is found where a window of the text holds at least 0.8 of its template's distinct five-word
    shingles; ``containment`` is the greatest share in a window and ``first_word`` the first word of the
    first such window. Texts without any template's anchor words are skipped, which loses none. Bands bring
    a window and a template together with a chance of at least 0.999; what they bring is verified exactly.
    With ``exact`` every window is verified against every template of its class instead, which misses none.
    Null texts and texts under five words hold nothing. Repeated rows each come back; a text may hold
    several licenses. An empty table gives an empty result; further columns are not read.
    """
    templates = templates or TEMPLATES
    planned = plan_windows(templates)
    classes = sorted(set(planned.values()), key=lambda c: c.size)
    ids = {c: i for i, c in enumerate(classes)}
    hint = "(?iu)" + "|".join(sorted({re.escape(w) for t in templates.values() for w in anchors(t)}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).where(F.col("text").rlike(hint))
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ")
    rows = rows.select("doc_id", "row", words.alias("words")).where(F.size("words") >= SHINGLE)
    longest = SEGMENT + max(c.size for c in classes) + SHINGLE - 1
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(SEGMENT))
    cut = F.transform(starts, lambda s: F.struct(s.alias("from"), F.slice("words", s + 1, longest).alias("words")))
    rows = rows.select("doc_id", "row", F.explode(cut).alias("seg")).select("doc_id", "row", "seg.*").where(F.size("words") >= SHINGLE)
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, SHINGLE), " ")))
    rows = rows.select("doc_id", "row", "from", grams.alias("grams"))
    most = max(c.bands for c in classes)
    hashed = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda j: F.transform("grams", lambda h: F.xxhash64(h, j)))
    rows = rows if exact else rows.withColumn("hashed", hashed)
    last = F.least(F.lit(SEGMENT), F.size("grams")) - 1

    def windows(c: Windows):
        def one(s):
            cell = F.struct(F.lit(ids[c]).alias("kind"), (F.col("from") + s).alias("at"), F.slice("grams", s + 1, c.size).alias("held"))
            return cell if exact else cell.withField("lows", F.transform(F.slice("hashed", 1, c.bands), lambda h: F.array_min(F.slice(h, s + 1, c.size))))

        return F.transform(F.sequence(F.lit(0), last, F.lit(c.step)), one)

    found = rows.select("doc_id", "row", F.explode(F.concat(*[windows(c) for c in classes])).alias("w")).select("doc_id", "row", "w.*")
    # A row for each template and band: a fixed few.
    bands = F.broadcast(_bands(docs.sparkSession, templates, planned, ids))
    if exact:
        near = found.join(bands.where("band = 0").drop("band", "low"), "kind")
    else:
        near = found.select("doc_id", "row", "kind", "at", "held", F.posexplode("lows").alias("band", "low")).join(bands, ["kind", "band", "low"])
    share = F.size(F.array_intersect("held", "grams")) / F.size("grams")
    hit = near.withColumn("containment", share).where(F.col("containment") >= SIMILAR)
    return hit.groupBy("doc_id", "row", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word")).drop("row")


def licenses_sql(templates: dict[str, str] | None = None) -> str:
    """The same scan in DuckDB, of every window and without MinHash."""
    templates = templates or TEMPLATES
    planned = plan_windows(templates)
    rows = [(k, g, len(shingles_of(words_of(t))), planned[k].size, planned[k].step) for k, t in templates.items() for g in shingles_of(words_of(t))]
    values = ",\n".join(f"('{k}', '{g}', {n}, {size}, {step})" for k, g, n, size, step in rows)
    return f"""
WITH t(license, gram, n, size, step) AS (VALUES {values}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w WHERE len(w) >= {SHINGLE})),
m AS (SELECT doc_id, license, gram, p, n, unnest(range(greatest(0, ceil((p - size + 1) / step)::BIGINT * step), p + 1, step)) AS win
      FROM g JOIN t USING (gram)),
c AS (SELECT doc_id, license, win, count(DISTINCT gram)::DOUBLE / any_value(n) AS containment FROM m GROUP BY doc_id, license, win)
SELECT doc_id, license, max(containment) AS containment, min(win)::BIGINT AS first_word
FROM c WHERE containment >= {SIMILAR} GROUP BY doc_id, license
"""
