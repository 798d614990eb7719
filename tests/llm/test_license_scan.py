"""Operator 2: the scan's classes, its prefilter and its edge cases."""

import math

import pytest

from ticketsift.llm import license_scan as ls


@pytest.fixture(scope="module")
def model():
    return ls.fit(["The cat sat on the mat.", "Rain fell over the hills and rivers.", "He was late and the train was gone."] * 20)


def plain_scan(text, model):
    """The same decision without Spark and without the prefilter."""
    at = {g: k for k, g in enumerate(model.grams)}
    n = len(model.families) + 1
    out = []
    for line, paragraph in enumerate(text.split("\n")):
        grams = set(ls.grams_of(ls.words_of(paragraph)))
        z = [b + sum(model.weights[at[g] * n + c] for g in grams if g in at) for c, b in enumerate(model.bias)]
        best = max(range(n), key=lambda c: (z[c], -c))
        if best == n - 1:
            continue
        p = 1 / sum(math.exp(x - max(z)) for x in z)
        shares = [len(grams & set(t)) / len(t) for f, t in model.templates if f == best]
        ok = bool(shares) and max(shares) >= ls.CONFIRM and p >= model.least
        out.append((line, model.families[best] if ok else ls.UNKNOWN))
    return out


def test_scan_matches_plain_python_and_handles_odd_rows(spark, model):
    texts = [
        "The train was late.\nThis text is licensed under CC BY-SA 4.0.", "Released under the MIT License.", "licensed under the EUPL 1.2 License",
        "Copyright (c) 2020 Foo. All rights reserved.", None, "", "\n\n", "word " * 20_000 + "licensed under the Apache License, Version 2.0", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 License",
    ]
    rows = [(None if k == 1 else k, t, "x", "y") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, _score string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 1, r["line"], r["family"]) for r in ls.scan(df, model).collect())
    want = sorted((k, line, family) for k, t in enumerate(texts) for line, family in plain_scan(t or "", model))
    assert got == want
    assert {f for _, _, f in got} >= {"MIT", "CC-BY-SA", "GPL", "proprietary", "Apache-2.0", "CC-BY-NC", ls.UNKNOWN}


def test_ordinary_text_is_left_alone_and_empty_table(spark, model):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ls.ORDINARY)], "doc_id long, text string")
    assert ls.scan(df, model).count() == 0
    assert ls.scan(df.where("false"), ls.train(df.where("false"))).count() == 0


def test_prefilter_words_cover_every_winning_paragraph(model):
    import re

    search = re.compile(model.pattern())
    for family, text in ls.variants():
        if plain_scan(text, model):
            assert search.search(text), (family, text)


def test_wrapped_notices_are_seen_whole(spark, model):
    mit = """Permission is hereby granted, free of charge, to any
person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights"""
    bsd = """ * Redistribution and use in source and binary
 * forms, with or without modification, are
 * permitted provided that the following
 * conditions are met:"""
    gpl = """# This program is free software: you can redistribute it and/or
# modify it under the terms of the GNU General
# Public License as published by the Free
# Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    apache = """// Licensed under the Apache
// License, Version
// 2.0 (the "License"); you may not use this file"""
    texts = {
        1: (f"The train was late.\n\n{mit}\n\nRain fell over the hills.", [(2, "MIT")]),
        2: (f"/*\n{bsd}\n */\nint main;", [(1, "BSD")]),
        3: (f"#!/bin/sh\n#\n{gpl}\n#\n# Rain fell.\n", [(2, "GPL")]),
        4: (f"x\r\n\r\n{apache}".replace("\n//", "\r\n//"), [(2, "Apache-2.0")]),
        5: ("MIT License\n\nCopyright (c) 2020 Foo. All rights reserved.\n", [(0, "MIT"), (2, "proprietary")]),
        6: ("The train was late.\nRain fell over\nthe hills.", []),
        7: ("The train was late.\nReleased under the MIT License\nlicensed under the Apache License, Version 2.0", [(1, "MIT"), (2, "Apache-2.0")]),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {k: [] for k in texts}
    for r in ls.scan(df, model).collect():
        got[r["doc_id"]].append((r["line"], r["family"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in texts.items()}
