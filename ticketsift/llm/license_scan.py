"""Licence scans by a trained paragraph classifier (operator 2), in DataFrame functions.

A sparse (L1) softmax regression over word n-grams separates licence families
and ordinary text.  It is fitted on the driver from variants of the templates
below and a bounded sample of the corpus' own paragraphs; its few weights are
constants of the scan.  A family needs a calibrated probability, else the
paragraph is ``unknown`` (a class of its own, trained on licences of other
names); and its templates must be met in the paragraph, else
it is ``unknown`` as well.  Paragraphs lie between blank lines (lines of comment
marks alone are blank, too).  Each line is judged by itself, and a paragraph of
several lines as a whole with line breaks and comment marks folded to blanks, so
wrapped notices are seen whole; a whole paragraph counts where it names a licence
that none of its lines names alone, and then stands for its doubtful lines.
Texts without any word that speaks for a family cannot win against ordinary
text, so one pattern search leaves nearly all of the text unsplit without
changing the result.

Rows: null and empty texts have no paragraphs; null ids, repeated rows and ids
keep their rows; extra columns are not read; empty tables give no rows (the
model is then fitted on the templates alone).
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: how licences are announced (short public notices) ------------
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "released under the MIT License",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "licensed under the GNU General Public License, version 3",
        "licensed under the GPLv3",
        "GNU General Public License Version 3",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": ["licensed under the GNU Lesser General Public License", "licensed under the LGPL"],
    "AGPL": ["licensed under the GNU Affero General Public License", "licensed under the AGPL"],
    "BSD": [
        "licensed under the BSD 3-Clause License",
        "licensed under the BSD 2-Clause License",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the MPL 2.0", "Mozilla Public License Version 2.0"],
    "ISC": ["released under the ISC License", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "released under the Unlicense"],
    "CC0": ["dedicated to the public domain under CC0 1.0", "licensed under CC0 1.0 Universal"],
    "CC-BY": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 License"],
    "CC-BY-NC": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 License"],
    "CC-BY-ND": ["licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 License"],
    "CC-BY-NC-SA": ["licensed under CC BY-NC-SA 4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License"],
    "proprietary": ["All rights reserved", "Copyright Example Corporation. All rights reserved", "proprietary and confidential, unauthorized copying is prohibited"],
}
OPENINGS = ("", "This work is ", "This software is ", "The source code is ", "The contents of this page are ", "Copyright (c) 2021 The Authors. ", "Unless noted otherwise, text is ")
ENDINGS = ("", ".", ", see the file for details.", ". See www.example.com for the full text.", ". It comes without warranty.")
#: Announcements of licences without a family of their own, and names to put into them.
OTHER = ("licensed under the {} License", "released under the {} license, version 2", "distributed under the terms of the {} Public License", "licensed under the {}", "the license is the {} License 1.1")
OTHER_NAMES = ("Example", "Artistic", "EUPL", "Open Data", "Eclipse", "Acme Community", "WTFPL", "Zlib", "Sample")
#: Ordinary sentences that use the same words.
ORDINARY = (
    "He lost his driving license in the city", "The doctor is licensed to work in this state", "They asked for permission to enter the house",
    "The public library has general information", "All seats are reserved for members", "Copy the file and open it in the other window",
    "The commons was full of people", "Her creative work was shown in public", "The version of the story is free of errors",
    "Apache helicopters were seen", "The school at MIT opened in the spring", "Terms and conditions of the contract were met",
    "Attribution of the painting is under discussion", "The source of the river lies in the hills", "Foundation stones of free software for all",
    "Human rights are discussed by the committee", "The domain name was registered", "The general asked the public for help",
)
# ------------------------------------------------------------------------------
#: Corpus paragraphs (of at most so many characters) that stand for ordinary text, from about so many documents.
SAMPLE_LINES, SAMPLE_CHARS, SAMPLE_DOCS = 1500, 400, 2000
#: What may be a licence line in that sample and is left out of it.
SUSPECT = "(?i)licen[cs]|copyright|rights reserved|public domain|creative commons|\\bgpl|\\bcc0|\\bcc by"
GRAMS = (1, 2, 3)
#: Templates of so few words stand alone as titles: so many training paragraphs are nothing else.
TITLE_WORDS, TITLE_TIMES = 3, 10
ROUNDS, RATE, L1 = 400, 0.5, 4e-4
#: A word of more ordinary paragraphs than this share is common: n-grams of such words alone are no features.
COMMON = 0.02
#: Share of a template's n-grams that a paragraph must hold.
CONFIRM = 0.6
UNKNOWN = "unknown"
#: A line that ends a paragraph, and what comments put before and behind a line.
BLANK = r"^[^\p{L}\p{N}]*$"
MARKS = r"^\s*(?:(?i:dnl|rem)\s+|[^\p{L}\p{N}(\[\"'<]*)|[\s*/]+$"
#: Stands between the number and the text of a line, and for words that the model does not know.
CUT = "\u0001"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in GRAMS for i in range(len(words) - n + 1)]


class LicenseModel:
    """Weights of the n-grams, calibration and templates, all as plain lists."""

    def __init__(self, families: list[str], grams: list[str], weights: np.ndarray, bias: np.ndarray, least: float, common: set[str]):
        self.families, self.grams, self.least = families, grams, least
        self.weights = [float(x) for x in weights.ravel()]  # a row per n-gram: families, then ordinary text
        self.bias = [float(x) for x in bias]
        # words of n-grams that speak for some family against ordinary text
        gain = (weights[:, :-1] - weights[:, -1:]).max(axis=1) if len(grams) else np.zeros(0)
        self.cues = sorted({w for g, x in zip(grams, gain, strict=True) if x > 0 for w in g.split(" ") if w not in common})
        self.templates = [(k, sorted({g for g in grams_of(words_of(t)) if not common.issuperset(g.split(" "))})) for k, f in enumerate(families) for t in TEMPLATES.get(f, ())]

    def pattern(self) -> str:
        """A search for the cue words."""
        return f"(?i)(?<![a-z0-9]){one_of(self.cues)}(?![a-z0-9])"

    def strange(self) -> str:
        """A search for words (in lower case) that are in no n-gram of the model."""
        known = {w for g in self.grams for w in g.split(" ")} | {w for _, t in self.templates for g in t for w in g.split(" ")}
        return f"(?<![a-z0-9])(?!{one_of(sorted(known))}(?![a-z0-9]))[a-z0-9]+"


def one_of(words: list[str]) -> str:
    """A pattern of words, grouped by their first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(f"{c}(?:{'|'.join(ws)})" for c, ws in by.items()) + ")"


def variants(seed: int = 2) -> list[tuple[str, str]]:
    """Training paragraphs: templates with openings, endings and lost words."""
    rng, out = random.Random(seed), []
    for family, templates in TEMPLATES.items():
        for t in templates:
            if len(t.split(" ")) <= TITLE_WORDS:
                out += [(family, t)] * TITLE_TIMES
            for opening in OPENINGS:
                words = (opening + t).split(" ")
                out.append((family, " ".join(words) + rng.choice(ENDINGS)))
                if len(words) > 8:
                    out.append((family, " ".join(w for w in words if rng.random() > 0.1)))
    for t in OTHER:
        for name in OTHER_NAMES:
            out.append((UNKNOWN, rng.choice(OPENINGS) + t.format(name) + rng.choice(ENDINGS)))
    return out


def fit(ordinary: list[str]) -> LicenseModel:
    """Sparse softmax regression by proximal gradient steps; the least probability
    of a family is what no held-out ordinary paragraph reaches."""
    families = [*TEMPLATES, UNKNOWN]
    plain = [*ORDINARY, *ordinary]
    told = [(families.index(f), words_of(t)) for f, t in variants()]
    held = [words_of(t) for t in plain[::5]]
    rest = [words_of(t) for k, t in enumerate(plain) if k % 5] + [words_of(t) for t in ORDINARY]
    counts: dict[str, int] = {}
    for ws in rest + held:
        for w in set(ws):
            counts[w] = counts.get(w, 0) + 1
    common = {w for w, n in counts.items() if n > max(2, COMMON * (len(rest) + len(held)))}
    rows = [(k, set(grams_of(ws))) for k, ws in told] + [(len(families), set(grams_of(ws))) for ws in rest]
    seen: dict[str, int] = {}
    for k, gs in rows[: len(told)]:
        for g in gs:
            seen[g] = seen.get(g, 0) + 1
    grams = sorted(g for g, n in seen.items() if n >= 2 and not common.issuperset(g.split(" ")))
    at = {g: k for k, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)), dtype=np.float32)
    y = np.zeros((len(rows), len(families) + 1), dtype=np.float32)
    for r, (k, gs) in enumerate(rows):
        x[r, [at[g] for g in gs if g in at]] = 1
        y[r, k] = 1
    share = 1 / np.maximum(y.sum(axis=0), 1)
    weight = (y @ np.where(np.arange(len(share)) < len(families), share, share * 4))[:, None]  # every family alike
    weight /= weight.sum()
    w, b = np.zeros((len(grams), y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    b[-1] = 2.0
    for _ in range(ROUNDS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - y) * weight
        w -= RATE * 10 * (x.T @ off)
        b -= RATE * off.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * 10 * L1 / 10, 0)
        b[:-1] = np.minimum(b[:-1], b[-1] - 0.5)  # without evidence a paragraph is ordinary
    used = np.abs(w).max(axis=1) > 1e-4
    grams, w = [g for g, u in zip(grams, used, strict=True) if u], w[used]
    model = LicenseModel(families, grams, w, b, 0.5, common)
    at = {g: k for k, g in enumerate(grams)}
    top = 0.5
    for ws in held:
        z = b + sum((w[at[g]] for g in set(grams_of(ws)) if g in at), np.zeros_like(b))
        p = np.exp(z - z.max())
        if z.argmax() < len(families):
            top = max(top, float((p / p.sum()).max()))
    model.least = min(0.9, top + 0.01)
    return model


def ordinary_sample(docs: DataFrame, id_col: str, text_col: str) -> list[str]:
    """A bounded sample of paragraphs without licence words."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64(F.lit(2), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    lines = picked.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.length("line").between(1, SAMPLE_CHARS) & ~F.col("line").rlike(SUSPECT))
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    return fit(ordinary_sample(docs, id_col, text_col))


def _constant(value: object, kind: str) -> Column:
    """A literal of a nested type (folded once by the optimizer)."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(words: Column) -> Column:
    """N-grams of a word array (an array without repeats)."""
    def run(n: int) -> Column:
        last = F.size(words) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(*[run(n) for n in GRAMS]))


def _run_grams(run: Column) -> Column:
    return _grams(F.filter(F.split(run, "[^a-z0-9]+"), lambda w: w != ""))


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed here, once: a filter on it is not
    pushed below a generator, which would repeat the expression in the filter."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence paragraph: id, ``line`` (number), ``family``,
    ``probability`` of the best family, ``best_family``, ``template_share``,
    ``confirmed`` and the ``paragraph``."""
    if not model.cues:
        return docs.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("family", "string"), ("best_family", "string"), ("probability", "double"), ("template_share", "double"), ("confirmed", "boolean"), ("paragraph", "string"))]).where(F.lit(False))
    pattern, n = model.pattern(), len(model.families) + 1
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.when(x.rlike(BLANK), F.lit("")).otherwise(F.concat(i.cast("string"), F.lit(CUT), x)))
    found = docs.where(F.col(text_col).rlike(pattern)).select(F.col(id_col), F.explode(F.split(F.array_join(numbered, "\n"), "\n\n+")).alias("_text"))
    found = found.where(F.col("_text").rlike(pattern))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, CUT, 1).cast("int").alias("line"), F.substr(x, F.instr(x, CUT) + 1).alias("paragraph"), F.lit(False).alias("whole")))
    found = _computed(found, "_lines", lines).drop("_text")
    folded = F.array_join(F.transform("_lines", lambda x: F.regexp_replace(x["paragraph"], MARKS, "")), " ")
    whole = F.when(F.size("_lines") > 1, F.array(F.struct(F.col("_lines")[0]["line"].alias("line"), folded.alias("paragraph"), F.lit(True).alias("whole")))).otherwise(F.filter("_lines", lambda x: F.lit(False)))
    found = _computed(found, "_seen", F.concat(F.filter("_lines", lambda x: x["paragraph"].rlike(pattern)), whole)).drop("_lines")
    # n-grams that hold a word the model does not know are none of its own: only the runs between such words are cut
    found = _computed(found, "_grams", F.transform("_seen", lambda x: F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(F.lower(x["paragraph"]), model.strange(), CUT), CUT), _run_grams)))))
    names, weights, bias = _constant(model.grams, "array<string>"), _constant(model.weights, "array<double>"), _constant(model.bias, "array<double>")
    found = _computed(found, "_at", F.transform("_grams", lambda gs: F.filter(F.transform(gs, lambda g: F.array_position(names, g)), lambda p: p > 0)))
    score = lambda at: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda c: F.element_at(bias, c) + F.aggregate(at, F.lit(0.0), lambda a, p: a + F.element_at(weights, ((p - 1) * n).cast("int") + c)))
    found = _computed(found, "_score", F.transform("_at", score))
    found = _computed(found, "_best", F.transform("_score", lambda z: F.struct(F.array_position(z, F.array_max(z)).cast("int").alias("k"), F.array_max(z).alias("top"))))
    templates = _constant([{"f": k + 1, "g": g} for k, g in model.templates], "array<struct<f:int,g:array<string>>>")
    share = lambda x: F.array_max(F.transform(F.filter(templates, lambda t: t["f"] == x["_best"]["k"]), lambda t: F.size(F.array_intersect(t["g"], x["_grams"])) / F.size(t["g"])))
    verdict = lambda x: F.struct(
        x["_seen"]["line"].alias("line"), x["_seen"]["paragraph"].alias("paragraph"), x["_seen"]["whole"].alias("whole"), F.element_at(_constant(model.families, "array<string>"), x["_best"]["k"]).alias("best_family"),
        (1 / F.aggregate(x["_score"], F.lit(0.0), lambda a, z: a + F.exp(z - x["_best"]["top"]))).alias("probability"), share(x).alias("template_share"),
    )
    found = _computed(found, "_verdicts", F.transform(F.filter(F.arrays_zip("_seen", "_grams", "_score", "_best"), lambda x: x["_best"]["k"] < n), verdict))
    found = found.select(id_col, "_verdicts").where(F.size("_verdicts") > 0)
    sure = lambda v: v["probability"] >= model.least
    named = lambda v: sure(v) & F.coalesce(v["template_share"] >= CONFIRM, F.lit(False))
    single, folded = F.filter("_verdicts", lambda v: ~v["whole"]), F.filter("_verdicts", lambda v: v["whole"])
    new = F.filter(folded, lambda w: named(w) & ~F.exists("_verdicts", lambda v: ~v["whole"] & named(v) & (v["best_family"] == w["best_family"])))
    # doubtful lines are parts of the new notice, unless they tell of a licence of another name
    other = F.filter(single, lambda v: named(v) | (sure(v) & (v["best_family"] == UNKNOWN)))
    doubtful = F.when(F.size(single) > 0, single).otherwise(F.filter(folded, lambda w: sure(w) & (w["best_family"] == UNKNOWN)))
    rows = found.select(id_col, F.explode(F.when(F.size(new) > 0, F.concat(new, other)).otherwise(doubtful)).alias("_v"))
    confirmed = F.coalesce(F.col("_v.template_share") >= CONFIRM, F.lit(False))
    family = F.when(named(F.col("_v")), F.col("_v.best_family")).otherwise(UNKNOWN)
    return rows.select(id_col, "_v.line", family.alias("family"), "_v.best_family", "_v.probability", "_v.template_share", confirmed.alias("confirmed"), "_v.paragraph")
