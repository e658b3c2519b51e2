from __future__ import annotations

import random
import re

import pytest

from contrail.llm import license_scan as L


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text, templates):
    """{template: best containment over all windows of its group} by trying every window.

    A template only counts where none that begins at the same word is found more fully.
    """
    kinds = {i: frozenset(shingles(t)) for i, (_, t) in enumerate(templates)}
    fake = {i: frozenset(hash(s) for s in k) for i, k in kinds.items()}
    doc, found, places = shingles(text), {}, {}
    for w in L.windows_for(fake):
        for at in range(0, max(1, len(doc)), w.stride):
            part = set(doc[at : at + w.length])
            for t in w.templates:
                c = len(part & kinds[t]) / len(kinds[t])
                if c >= L.CONTAINMENT:
                    first = next(k for k in range(at, at + w.length) if doc[k] in kinds[t])
                    places.setdefault(first, set()).add((c, t))
    for seen in places.values():
        for c, t in seen:
            if c == max(seen)[0]:
                found[t] = max(c, found.get(t, 0))
    return found


def documents():
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    docs = []
    for i in range(160):
        body = [filler(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            name, text = L.TEMPLATES[rng.randrange(len(L.TEMPLATES))]
            words = text.split()
            if i % 3 == 1 and len(words) > 20:  # an edit near the end
                words[-2] = "zzz"
            if i % 5 == 2:
                words = [w.upper() for w in words]
            body += [rng.choice([" ", "\n", "-- "]).join(words), filler(rng.randint(0, 90))]
        docs.append((i, rng.choice([" ", "\n# "]).join(body)))
    return docs


def test_matches_equal_trying_every_window(spark):
    docs = documents()
    got: dict = {}
    for r in L.license_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.template] = r.containment
    want = {i: f for i, t in docs if (f := brute(t, L.TEMPLATES))}
    assert sum(map(len, want.values())) > 60
    exact = {(i, t) for i, f in want.items() for t, c in f.items() if c == 1}
    assert {(i, t) for i, f in got.items() for t, c in f.items() if c == 1} == exact
    some = {(i, t) for i, f in want.items() for t in f}
    found = {(i, t) for i, f in got.items() for t in f}
    assert found <= some and len(found) >= 0.99 * len(some)


def test_bands_reach_the_chance():
    for n in (1, 2, 3, 5, 8, 13, 40, 200):
        (w,) = L.windows_for({0: frozenset(range(n))})
        held = -(-int(n * L.CONTAINMENT * 1000) // 1000)
        similar = held / (w.length + n - held)
        assert w.length >= n and 1 - (1 - similar) ** w.bands >= L.CHANCE


@pytest.mark.parametrize("name", ["documents"])
def test_planted_lines_of_the_table(spark, name):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    lines = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "licensed under the GNU General Public License, version 3.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
    }
    want = {(r.doc_id, k) for r in docs.collect() for k, t in lines.items() if t in r.text}
    assert len(want) > 5 and {(r.doc_id, r.license) for r in L.licenses_of(docs).collect()} == want


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "under the MIT License"), (4, "Released under the MIT License"), (4, "Released under the MIT License"),
        (None, "x released UNDER the mit license"), (6, "w " * 60000 + "Released under the MIT License. " + "v " * 60000),
        (7, "Licensed under CC BY 4.0"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, mark int")
    got = {(r.doc_id, r.license, r.containment, r.at_word) for r in L.licenses_of(df).collect()}
    assert got == {(4, "MIT", 1.0, 0), (None, "MIT", 1.0, 1), (6, "MIT", 1.0, 60000), (7, "CC-BY-4.0", 1.0, 0)}
    assert L.licenses_of(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.license_matches(df, templates=[("X", "four words are short")])


def test_versions_that_share_wording_are_told_apart(spark):
    gnu = (
        "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public"
        " License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any"
        " later version."
    )
    opening = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: "
    )
    clauses = (
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
        " and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    )
    names = (
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission. "
    )
    ends = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
    notices = [
        ("GPL-2.0", gnu.format("program", ";", "", ";", "2")), ("GPL-3.0", gnu.format("program", ":", "", ",", "3")),
        ("LGPL-2.1", gnu.format("library", ";", "Lesser ", ";", "2.1")), ("LGPL-3.0", gnu.format("library", ":", "Lesser ", ",", "3")),
        ("AGPL-3.0", gnu.format("program", ":", "Affero ", ",", "3")), ("LGPL", gnu.format("library", ";", "Lesser ", ".", "x").split(". either")[0]),
        ("BSD-2-Clause", opening + clauses + ends), ("BSD-3-Clause", opening + clauses + names + ends), ("BSD", opening),
        *((f"CC-{k.replace(' ', '-')}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    ]
    rows = [(i * 20 + k, "filler " * k + text + " and so on" * 9) for i, (_, text) in enumerate(notices) for k in range(0, 20, 3)]
    got: dict = {}
    for r in L.licenses_of(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {k: v for k, v in got.items() if v != {notices[k // 20][0]}} == {} and len(got) == len(rows)
