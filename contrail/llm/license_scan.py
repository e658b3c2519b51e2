"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits in lower case, shingles five words. Templates of like length share a window: as long as
the longest of them plus one stride, so that every place a template can stand lies whole in some window. The number of bands
(one minimum each) follows from the least Jaccard similarity that a window with CONTAINMENT of a template can have, so that
such a window shares a band with probability CHANCE at least. Each band orders the 64-bit shingle hashes by another mask.

A window's minimum is one of its shingles. A text without any of the templates' minima can share no band with them, so its
windows are not built; this changes no result. Candidate windows join the table of band values, and the share of the
template's shingles in the window decides. Of templates that begin at the same word the one found most fully is reported,
so that a license is not taken for another version of itself.

Only column expressions are used, and nothing but candidates is shuffled.

Defined cases: null, empty and short texts (under five words) hold no template; a template must have five words; repeated rows
with equal key and text are one row of the result; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as Frame
from pyspark.sql import functions as F


SHINGLE = 5
CONTAINMENT = 0.8
CHANCE = 0.99
GROWTH = 1.3
MASKS = 64
# Licenses and notices they are recognised by. Wording that versions share stands for the family (LGPL, BSD).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with"
        " the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    (
        "BSD-2-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"
        " BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
)

# Families by their shared wording, and the licenses that have it.
FAMILIES = {"LGPL": ("LGPL-2.1", "LGPL-3.0"), "BSD": ("BSD-2-Clause", "BSD-3-Clause")}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hash of every five neighbouring words of a text.

    The word hashes are bound to a variable (a one-element array), so that they are made once however the expression is
    moved: a filter on the result is evaluated below the projection that names it.
    """
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - SHINGLE)
        return F.when(
            F.size(w) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
        ).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), shingles), F.lit(0))


def mask(band: int) -> int:
    """A signed 64-bit mask for each band, from the multiples of an odd constant."""
    value = (band * 0x9E3779B97F4A7C15) % 2**64
    return value - 2**64 if value >= 2**63 else value


@dataclass(frozen=True)
class Window:
    """Templates of like length, by shingles: the window's length and stride, the bands, and the bands' minima."""

    longest: int
    stride: int
    length: int
    bands: int
    templates: tuple[int, ...]
    minima: tuple[tuple[int, int, int], ...]  # (band, value, template)


def windows_for(templates: dict[int, frozenset[int]]) -> list[Window]:
    """Windows for templates given by their distinct shingle hashes."""
    found, waiting = [], sorted(templates, key=lambda t: len(templates[t]))
    while waiting:
        shortest = len(templates[waiting[0]])
        group = [t for t in waiting if len(templates[t]) <= shortest * GROWTH]
        waiting = waiting[len(group) :]
        longest = max(len(templates[t]) for t in group)
        stride = max(1, longest // 4)
        length = longest + stride - 1
        least = 1.0
        for t in group:
            own = len(templates[t])
            held = math.ceil(CONTAINMENT * own)
            least = min(least, held / (length + own - held))
        bands = 1 if least >= CHANCE else math.ceil(math.log(1 - CHANCE) / math.log(1 - least))
        minima = tuple((b, min(h ^ mask(b) for h in templates[t]), t) for b in range(min(bands, MASKS)) for t in group)
        found.append(Window(longest, stride, length, min(bands, MASKS), tuple(group), minima))
    return found


def template_shingles(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> dict[int, frozenset[int]]:
    """Shingle hashes of each template, by its place in the given list."""
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "template int, text string")
    hashed = rows.select("template", shingle_hashes(F.col("text")).alias("h"))
    found = {r["template"]: frozenset(r["h"]) for r in hashed.collect()}
    if short := [templates[i][1] for i, h in found.items() if not h]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    return found


def _listed(values: Sequence[int]) -> str:
    return ", ".join(f"{v}L" if v != -(2**63) else f"({v + 1}L - 1L)" for v in sorted(set(values)))


def _candidates(number: int, w: Window) -> str:
    """SQL: windows of the shingle array h that share a band with a template of theirs, with the shingles in them."""
    places = f"sequence(0, CAST(ceil(greatest(size(h) - {w.length}, 0) / {w.stride}) AS INT))"
    own = f"array({_listed([v ^ mask(b) for b, v, _ in w.minima])})"
    bands = [
        f"""filter(transform({places}, j -> named_struct('kind', {number}, 'band', {b}, 'at', j * {w.stride},
            'value', array_min(transform(slice(h, j * {w.stride} + 1, {w.length}), x -> x ^ {mask(b)}L)))),
            c -> c.value IN ({_listed([v for k, v, _ in w.minima if k == b])}))"""
        for b in range(w.bands)
    ]
    return f"""CASE WHEN arrays_overlap(h, {own}) THEN transform(concat({', '.join(bands)}), c -> named_struct(
        'kind', c.kind, 'band', c.band, 'at', c.at, 'value', c.value, 'shingles', slice(h, c.at + 1, {w.length}))) END"""


def license_matches(
    df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES
) -> DataFrame:
    """(key, license, template, containment, at_word, mark): each template found in a text, at its best first place."""
    spark = df.sparkSession
    shingles = template_shingles(spark, templates)
    windows = windows_for(shingles)
    band_table = spark.createDataFrame(
        [(n, b, v, t) for n, w in enumerate(windows) for b, v, t in w.minima], "kind int, band int, value long, template int"
    )
    template_table = spark.createDataFrame(
        [(t, name, sorted(shingles[t])) for t, (name, _) in enumerate(templates)],
        "template int, license string, template_shingles array<long>",
    )
    minima = [v ^ mask(b) for w in windows for b, v, _ in w.minima]
    hashed = df.select(
        df[key].alias("own_key"), F.xxhash64(df[text].cast("string")).alias("mark"), shingle_hashes(df[text]).alias("h")
    ).where(f"arrays_overlap(h, array({_listed(minima)}))")
    parts = ", ".join(f"coalesce({_candidates(n, w)}, array())" for n, w in enumerate(windows))
    found = (
        hashed.select("own_key", "mark", F.explode(F.expr(f"concat({parts})")).alias("c"))
        .select("own_key", "mark", "c.*")
        .join(F.broadcast(band_table), ["kind", "band", "value"])  # as many rows as bands of the given templates
        .join(F.broadcast(template_table), "template")
        .withColumn("shared", F.array_intersect("shingles", "template_shingles"))
        .withColumn("containment", F.size("shared") / F.size("template_shingles"))
        .where(F.col("containment") >= CONTAINMENT)
        .withColumn("at_word", F.col("at") + F.array_position("shingles", _first_of("shingles", "shared")) - 1)
    )
    here = Frame.partitionBy("own_key", "mark", "at_word")  # as many rows as templates and windows that meet here
    fullest = found.withColumn("most", F.max("containment").over(here)).where(F.col("containment") == F.col("most"))
    best = F.min(F.struct((-F.col("containment")).alias("less"), "at_word"))
    return (
        fullest.groupBy("own_key", "mark", "license", "template")
        .agg(best.alias("best"))
        .select(
            F.col("own_key").alias(key), "license", "template", (-F.col("best.less")).alias("containment"), F.col("best.at_word"), "mark"
        )
    )


def _first_of(values: str, wanted: str) -> Column:
    """The first of the values that is wanted."""
    return F.expr(f"filter({values}, x -> array_contains({wanted}, x))[0]")


def _without_less_full(found: DataFrame, key: str, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """The found templates over whose place no other license is found more fully."""
    words = F.array(*[F.lit(len(re.findall(r"[^\W_]+", t))) for _, t in templates])
    here = Frame.partitionBy(key, "mark")  # as many rows as templates found in a text
    rows = found.withColumn("own", F.struct("license", "containment", "at_word", F.get(words, F.col("template")).alias("words")))
    fuller = """exists(others, o -> o.license <> own.license AND o.containment > own.containment
        AND abs(o.at_word - own.at_word) < least(o.words, own.words))"""
    return rows.withColumn("others", F.collect_set("own").over(here)).where(f"NOT {fuller}").drop("own", "others")


def licenses_of(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per key, text and license found: key, license, containment, at_word, n_templates, text_mark.

    A family is only reported for texts in which none of its licenses is found.
    """
    found = _without_less_full(license_matches(df, key, text, templates), key, templates)
    best = F.min(F.struct((-F.col("containment")).alias("less"), "at_word"))
    grouped = found.groupBy(key, "mark", "license").agg(best.alias("best"), F.count(F.lit(1)).alias("n_templates"))
    here = Frame.partitionBy(key, "mark")  # as many rows as licenses found in a text
    for family, members in FAMILIES.items():
        told = F.max(F.col("license").isin(*members)).over(here)
        grouped = grouped.withColumn("told", (F.col("license") == family) & told).where("NOT told").drop("told")
    return grouped.select(
        key, "license", (-F.col("best.less")).alias("containment"), F.col("best.at_word").alias("at_word"), "n_templates",
        F.col("mark").alias("text_mark"),
    )
