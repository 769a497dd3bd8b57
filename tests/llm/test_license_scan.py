import textwrap
from collections import Counter
from math import log, sqrt

import pytest

from lexmill.llm import license_scan as L
from lexmill.llm.queries import QUERIES

APACHE, MIT = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."


def brute_best(text, files, df):
    idf = lambda w: log((files + 1) / (df.get(w, 0) + 1)) + 1
    vec = lambda s: {w: n * (idf(w) if w in L.VOCABULARY else log(files + 1) + 1) for w, n in Counter(L.terms(s)).items()}
    size = lambda v: sqrt(sum(x * x for x in v.values()))
    v = vec(text)
    told = L.telling(set(v))
    open_ = [(n, vec(s)) for n, s in L.TEMPLATES if L.telling(set(L.terms(s))) <= told and not (told - L.telling(set(L.terms(s)))) & (L._TELLING | L._CODES)]
    scores = sorted((-sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / size(t), name) for name, t in open_)
    return (scores[0][1], -scores[0][0]) if scores and scores[0][0] else (None, 0.0)


@pytest.mark.parametrize("text", [APACHE, MIT + " the", "the version of this work", "Creative Commons Attribution-NonCommercial 4.0 International License"])
def test_cosine(text):
    df = {"the": 90, "under": 12, "license": 3}
    name, score = L.Templates(100, df).best(text)
    want = brute_best(text, 100, df)
    assert name == want[0] and abs(score - want[1]) < 1e-12


GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
HEADERS = [
    ("GPL-3.0", GNU.format("program", "", "3")), ("GPL-2.0", GNU.format("program", "", "2")), ("LGPL-3.0", GNU.format("library", "Lesser ", "3")),
    ("LGPL-2.1", GNU.format("library", "Lesser ", "2.1")), ("AGPL-3.0", GNU.format("program", "Affero ", "3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz."),
    (None, "This text is under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
]


@pytest.mark.parametrize("mark", ["// ", " * ", "# ", "-- ", "", "; "])
@pytest.mark.parametrize("name, header", HEADERS)
def test_wrapped_headers(name, header, mark):
    lines = "\n".join(mark + x for x in textwrap.wrap("Copyright 2019 A. Holder", 70) + [""] + textwrap.wrap(header, 70) + ["", "It comes WITHOUT ANY WARRANTY."])
    found = L.own_license(f"#!/bin/x\n\n{lines}\n\nint main();\n" + "prose without an end " * 40, False, L.Templates(1000, {}), 0.6)
    assert found[0] == name


def scan(spark, rows):
    df = spark.createDataFrame([(i, p, t, "c", 0) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, dir string, SCORE int")
    return {r.doc_id: (r.license, r.origin, r.line, r.directory) for r in L.license_scan(df).collect()}


def test_nearest_ancestor(spark):
    rows = [
        ("LICENSE", APACHE), ("a/x.py", "code"), ("a/b/LICENSE.txt", MIT), ("a/b/y.py", "code"), ("a/b/c/d/z.py", "code\n" + APACHE + "\n"),
        ("a/bc/w.py", "code"), (None, "code"), ("a/b/v.py", None), ("top.py", ""), ("a/b/COPYING", "nothing about it"), ("a/b/u.py", "One. " + MIT + " Two."), ("top.py", ""),
    ]
    got = scan(spark, rows)
    assert got == {
        0: ("Apache-2.0", "own", 0, None), 1: ("Apache-2.0", "inherited", 0, ""), 2: ("MIT", "own", 0, None), 3: ("MIT", "inherited", 0, "a/b"),
        4: ("Apache-2.0", "own", 2, None), 5: ("Apache-2.0", "inherited", 0, ""), 6: (None, None, None, None), 7: ("MIT", "inherited", 0, "a/b"),
        8: ("Apache-2.0", "inherited", 0, ""), 9: ("MIT", "inherited", 0, "a/b"), 10: ("MIT", "own", 1, None), 11: ("Apache-2.0", "inherited", 0, ""),
    }
    assert scan(spark, []) == {}
    assert scan(spark, [("x", "word " * 100_000 + "\n" + MIT)]) == {0: ("MIT", "own", 2, None)}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    df = Counter(w for r in docs for w in set(L.terms(r.text)) if w in L.VOCABULARY)
    got = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, sf).collect()}
    assert len(got) == len(docs)
    own, held = {}, {}

    def homes(r):
        shelf = f"{r.source}/{r.lang}/shelf{r.doc_id // 400}"
        return [f"{shelf}/section{r.doc_id // 100}", shelf]

    for r in docs:
        lines = r.text.split("\n")
        units = [u for k, line in enumerate(lines) if L._ANCHOR.search(line) for u in (line, L._wrapped(lines, k))]
        units += [p for u in units for p in L._SENTENCE.split(u) if L._ANCHOR.search(p)]
        states = "icense" in r.text or "icence" in r.text
        found = [brute_best(u, len(docs), df)[::-1] for u in units + [r.text] * states]
        own[r.doc_id] = max((f for f in found if f[0] >= 0.6), default=None)
        if states and own[r.doc_id]:
            home = homes(r)[1 if r.doc_id % 2 == 0 else 0]
            held.setdefault(home, []).append((-own[r.doc_id][0], own[r.doc_id][1]))
    origins = Counter()
    for r in docs:
        g = got[r.doc_id]
        near = next((h for h in homes(r) if h in held), None)
        if own[r.doc_id]:
            assert (g.license, g.origin) == (own[r.doc_id][1], "own") and abs(g.score - own[r.doc_id][0]) < 1e-6
            origins["own"] += 1
        elif near:
            assert (g.origin, g.directory) == ("inherited", near) and g.license in {x[1] for x in held[near] if x[0] <= min(held[near])[0] + 1e-6}
            origins["section" if near == homes(r)[0] else "shelf"] += 1
        else:
            assert g.license is None and g.origin is None
    assert origins["own"] > 5 and origins["section"] > 0 and origins["shelf"] > 20
