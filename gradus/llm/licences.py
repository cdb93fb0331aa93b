"""Licence scans: Dice coefficient of word bigrams against licence templates (DataFrame operations only).

Text is lower-cased and runs of characters other than 0-9, a-z and those from U+0080 on become one
space. Units are the lines of a text, and its paragraphs of several lines. A unit with bigram set A and
a template with set B match when ``2 |A & B| / (|A| + |B|) >= threshold``; the best template of a unit
counts (ties: the smaller name).

Pruning loses nothing. *Size*: a match needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``; a unit whose word
count is beyond every template's bound is dropped before any bigram is made. *Prefix*: a match shares
at least ``ceil(t |B| / (2 - t))`` bigrams, so any ``|B| - that + 1`` bigrams of the template, its
anchors, hold a shared one; units without an anchor are dropped by one set test.

``notices`` slides over the words of a whole text instead, whatever its lines: a window is a row of words
with at most as many bigrams as the size bound allows a match of its template. Of overlapping matches the best
counts (ties: the larger template, the smaller name, the shorter, the earlier window). The first and the last
bigram of a window that counts are shared ones, as any other would only lower the coefficient, so windows are
made between shared bigrams alone, where enough of them lie close together. ``scan`` is bound to lines and
paragraphs by the SQL of its query.

Templates are a parameter, a driver-side list of bounded size. One narrow pass: no shuffle, no join.

Defined results: null, empty and one-word texts match nothing; equal rows give equal results; an
empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
NOISE = r"[^\n0-9a-z\x80-\x{10FFFF}]+"

#: Public licence notices.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: The templates of ``notices``: the whole sentence of the MIT grant as well.
NOTICES = (*TEMPLATES, ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"))


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, in order of first occurrence."""
    words = re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))  # noqa: B905


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of which every match shares one; the longest words make the rarest bigrams."""
    need = math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]


def scan(docs: DataFrame, *, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, name: str = "licences") -> DataFrame:
    """``docs`` with an array column of (unit, licence, dice): units from 0 are lines, from -1 down are paragraphs."""
    known = [(n, g) for n, t in sorted(templates) if (g := bigrams(t))]
    ratio = (2 - threshold) / threshold + 1e-9  # bounds err on the side of keeping
    least = min((len(g) for _, g in known), default=0) / ratio
    most = max((len(g) for _, g in known), default=0) * ratio
    spots = sorted({a for _, g in known for a in anchors(g, threshold)})
    table = F.array(*(F.struct(F.lit(n).alias("licence"), F.array(*map(F.lit, g)).alias("grams")) for n, g in known))

    if not known:
        return docs.withColumn(name, F.array().cast("array<struct<unit:int,licence:string,dice:double>>"))
    norm = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), NOISE, " ")
    lines = F.transform(F.split("__norm", "\n"), lambda x, i: F.struct(i.alias("unit"), F.trim(x).alias("said")))
    parts = F.transform(F.split("__norm", "\n ?(?:\n ?)+"), lambda x, i: F.struct((-1 - i).alias("unit"), x.alias("said")))
    parts = F.transform(F.filter(parts, lambda u: F.contains(u["said"], F.lit("\n"))), lambda u: F.struct(u["unit"].alias("unit"), F.trim(F.regexp_replace(u["said"], " ?\n ?", " ")).alias("said")))

    def gaps(said: Column) -> Column:
        return F.length(said) - F.length(F.replace(said, F.lit(" "), F.lit("")))

    # a unit of g gaps has at most g bigrams; many gaps may hold few distinct bigrams, so they rule nothing out here
    long_enough = F.filter(F.concat(lines, parts), lambda u: gaps(u["said"]) >= max(1.0, least))
    # each step is a column of its own: a lambda would evaluate the expression that it uses for every element
    worded = F.transform("__sized", lambda u: F.struct(u["unit"].alias("unit"), F.split(u["said"], " ").alias("words")))
    marks = F.array_distinct(F.array(*(F.xxhash64(*map(F.lit, a.split(" "))) for a in spots)))

    def pairs(words: Column, joined) -> Column:
        return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: joined(w, F.get(words, i + 1)))

    anchored = F.filter("__worded", lambda u: F.arrays_overlap(pairs(u["words"], F.xxhash64), marks))
    grams = F.transform("__anchored", lambda u: F.struct(u["unit"].alias("unit"), F.array_distinct(pairs(u["words"], lambda a, b: F.concat(a, F.lit(" "), b))).alias("grams")))
    near = F.filter("__grams", lambda u: F.size(u["grams"]) <= most)

    def best(u: Column) -> Column:
        n = F.size(u["grams"])
        fit = F.filter(table, lambda t: (F.size(t["grams"]) <= n * ratio) & (n <= F.size(t["grams"]) * ratio))
        scored = F.transform(fit, lambda t: F.struct((-2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + F.size(t["grams"]))).alias("less"), t["licence"].alias("licence")))
        return F.array_min(scored)

    made = F.transform("__near", lambda u: F.struct(u["unit"].alias("unit"), best(u).alias("best")))
    found = F.filter("__made", lambda u: u["best"]["less"] <= -threshold + 1e-12)
    result = F.transform(found, lambda u: F.struct(u["unit"].alias("unit"), u["best"]["licence"].alias("licence"), F.round(-u["best"]["less"], 6).alias("dice")))
    for column, made_of, used in (
        ("__norm", norm, None), ("__sized", long_enough, "__norm"), ("__worded", worded, "__sized"), ("__anchored", anchored, "__worded"),
        ("__grams", grams, "__anchored"), ("__near", near, "__grams"), ("__made", made, "__near"), (name, result, "__made"),
    ):
        docs = docs.withColumn(column, made_of)
        docs = docs.drop(used) if used else docs
    return docs


def notices(docs: DataFrame, *, text: str = "text", templates=NOTICES, threshold: float = THRESHOLD, name: str = "notices") -> DataFrame:
    """``docs`` with an array column of (at, end, licence, dice): the words [at, end) of the text."""
    known = [(n, g, t) for n, t in sorted(templates) if (g := bigrams(t))]
    if not known:
        return docs.withColumn(name, F.array().cast("array<struct<at:int,end:int,licence:string,dice:double>>"))
    ratio = (2 - threshold) / threshold + 1e-9
    marks = F.array_distinct(F.array(*(F.xxhash64(*map(F.lit, a.split(" "))) for a in sorted({a for _, g, _ in known for a in anchors(g, threshold)}))))
    every = F.array(*map(F.lit, sorted({a for _, g, _ in known for a in g})))

    def template(name: str, grams: list[str], said: str) -> Column:
        need = math.ceil(threshold * len(grams) / (2 - threshold) - 1e-9)
        gaps = len(re.sub(r"[^0-9a-z\x80-\U0010FFFF]+", " ", said.lower()).split()) - 1
        most = max(int(len(grams) * ratio), gaps)
        return F.struct(F.lit(name).alias("licence"), F.lit(need).alias("need"), F.lit(most).alias("most"), F.array(*map(F.lit, grams)).alias("grams"))

    table = F.array(*(template(*x) for x in known))
    norm = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^0-9a-z\x80-\x{10FFFF}]+", " "))
    words = F.split("__norm", " ")

    def pairs(joined) -> Column:
        return F.transform(F.slice("__words", 1, F.size("__words") - 1), lambda w, i: joined(w, F.get("__words", i + 1)))

    some = F.arrays_overlap(pairs(F.xxhash64), marks)
    grams = F.when(some, pairs(lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    shared = F.filter(F.transform("__grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda x: F.array_contains(every, x["gram"]))
    spots = F.transform(table, lambda t: F.struct(t.alias("t"), F.filter("__shared", lambda x: F.array_contains(t["grams"], x["gram"])).alias("spots")))

    def ends(s: Column, x: Column, i: Column) -> Column:
        """The windows from the shared bigram x on: their last bigrams are shared ones, with enough of them between."""
        last = F.filter(F.slice(s["spots"], i + s["t"]["need"], s["t"]["most"]), lambda y: y["at"] - x["at"] < s["t"]["most"])
        return F.transform(last, lambda y: F.struct(s["t"].alias("t"), x["at"].alias("at"), F.array_distinct(F.slice("__grams", x["at"] + 1, y["at"] - x["at"] + 1)).alias("grams"), (y["at"] + 2).alias("end")))

    windows = F.flatten(F.transform("__spots", lambda s: F.flatten(F.transform(s["spots"], lambda x, i: ends(s, x, i)))))
    scored = F.transform("__windows", lambda w: F.struct(
        (-2.0 * F.size(F.array_intersect(w["grams"], w["t"]["grams"])) / (F.size(w["grams"]) + F.size(w["t"]["grams"]))).alias("less"),
        (-F.size(w["t"]["grams"])).alias("smaller"), w["t"]["licence"].alias("licence"), (w["end"] - w["at"]).alias("size"), w["at"].alias("at"), w["end"].alias("end"),
    ))
    ranked = F.array_sort(F.filter("__scored", lambda w: w["less"] <= -threshold + 1e-12))
    kept = F.aggregate(
        "__ranked", F.slice("__ranked", 1, 0),
        lambda made, w: F.when(F.exists(made, lambda k: (k["at"] < w["end"]) & (w["at"] < k["end"])), made).otherwise(F.concat(made, F.array(w))),
    )
    result = F.array_sort(F.transform("__kept", lambda w: F.struct(w["at"].alias("at"), w["end"].alias("end"), w["licence"].alias("licence"), F.round(-w["less"], 6).alias("dice"))))
    for column, made_of, used in (
        ("__norm", norm, None), ("__words", words, "__norm"), ("__grams", grams, "__words"), ("__shared", shared, None), ("__spots", spots, "__shared"),
        ("__windows", windows, "__spots"), ("__scored", scored, "__windows"), ("__ranked", ranked, "__scored"), ("__kept", kept, "__ranked"), (name, result, "__kept"),
    ):
        docs = docs.withColumn(column, made_of)
        docs = docs.drop(used) if used else docs
    return docs.drop("__grams")
