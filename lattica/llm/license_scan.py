"""License scans: MinHash bands over overlapping windows, then exact shingle containment, in SQL functions alone.

Words are runs of letters and digits, lower-cased; shingles are pairs of neighbouring words,
hashed to 64 bits.  A text's windows hold ``WINDOW`` words and begin every ``STRIDE``;
templates are cut into pieces of at most ``PIECE`` words, WINDOW - STRIDE + 1, so that some
window holds a whole occurrence of any piece.  A min-hash is the least shingle after an
exclusive or with a mask; each of ``BANDS`` masks is a band of one row.  A window retrieves
the templates of the pieces with which it agrees in a band.  A piece of the four shingles of
five words has a resemblance of 4 / 9 at least to the window that holds it, so that a band
agrees with probability 1 - (5 / 9) ** BANDS, over 0.9995; longer pieces come closer.  All
pieces of a notice retrieve it; of a text of more than 63 shingles ``ANCHORS`` pieces spread
over the text do, those with the longest words in their stretch of it.

What is retrieved is verified exactly.  The places in the document of all shingles of the
template are cut into local runs where they are more than ``WINDOW`` words, for long texts a
quarter of their shingles, apart, and for notices also where the template begins again: its
shingles, those it repeats aside, go back by more than half of it.  A run that holds ``CONTAINMENT`` of the template's distinct
shingles is an occurrence.  It is dropped only if most of its places belong to an occurrence
of another license with a greater product of share and matched shingles.  A license is
reported once, with its greatest share; several templates may have its SPDX identifier.

Only documents in which something is retrieved leave the scan.  Templates are a fixed, small
list of literals and of texts in ``license_texts``; the broadcast table of their shingles
does not grow with the input.

Defined results: null and empty texts, and texts of one word, hold no license; repeated rows
give repeated results; null ids are kept; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table

WINDOW, STRIDE = 10, 3
PIECE = WINDOW - STRIDE + 1
BANDS = 14
ANCHORS = 24
CONTAINMENT = 0.7

#: Short notices of public licenses, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Standard headers and other wordings, several for some identifiers.
_FSF = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
HEADERS = (
    ("AGPL-3.0", _FSF.format("Affero General Public License", "3")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", _FSF.format("General Public License", "2")),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", _FSF.format("General Public License", "3")),
    ("LGPL-2.1", _FSF.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", _FSF.format("Lesser General Public License", "3")),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
)

#: Identifiers as they stand in SPDX tags; those of versions only and or later are reported as the license.
_TAGGED = ("0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TAGS = tuple((name, f"SPDX-License-Identifier: {name}") for name in _TAGGED)


def texts() -> tuple[tuple[str, str], ...]:
    """Full license texts by SPDX identifier, from the files beside this module."""
    return tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def all_templates() -> tuple[tuple[str, str], ...]:
    return (*TEMPLATES, *HEADERS, *TAGS, *texts())


_WORD_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; no empty words."""
    return F.filter(F.split(F.lower(text), _WORD_BREAK, -1), lambda w: w != "")


def pieces_of(n: int) -> list[tuple[int, int]]:
    """First word and end of the pieces of a template of n words: PIECE words each, half overlapping."""
    if n <= PIECE:
        return [(0, n)]
    starts = list(range(0, n - PIECE, PIECE // 2)) + [n - PIECE]
    return [(s, s + PIECE) for s in starts]


def masks(bands: int, seed: int = 29) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(-(2**63), 2**63) for _ in range(bands)]


def _hashed(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> list:
    """Words and shingles of each template, by the same SQL functions as texts."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "k int, name string, text string").select("k", "name", words_of(F.col("text")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    found = rows.select("k", "name", "w", pairs.alias("h")).orderBy("k").collect()
    for r in found:
        if not r["h"]:
            raise ValueError(f"a template has one word pair at least: {r['name']}")
    return found


def _piece(r, s: int, e: int, bands: int) -> dict:
    part = r["h"][s : e - 1]
    return {"k": r["k"], "name": r["name"], "shingles": list(dict.fromkeys(part)), "least": [min(h ^ m for h in part) for m in masks(bands)]}


def _notice_pieces(r, bands: int) -> list[dict]:
    if len(set(r["h"])) > 63:
        raise ValueError(f"a notice has one to 63 word pairs, longer texts have anchors: {r['name']}")
    return [_piece(r, s, e, bands) for s, e in pieces_of(len(r["h"]) + 1)]


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], bands: int) -> list[dict]:
    """All pieces of notices with their shingles and min-hashes."""
    return [p for r in _hashed(spark, templates) for p in _notice_pieces(r, bands)]


def _anchors(r, bands: int) -> list[dict]:
    """Pieces of a long text: in each of ANCHORS stretches the one with the most letters."""
    pieces = pieces_of(len(r["h"]) + 1)
    each = max(1, len(pieces) / ANCHORS)
    stretches = [pieces[int(i * each) : int((i + 1) * each)] for i in range(min(ANCHORS, len(pieces)))]
    return [_piece(r, *max(x, key=lambda p: sum(map(len, r["w"][p[0] : p[1]]))), bands) for x in stretches]


def shingles_of(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words, bound once by a lambda over an array of one."""
    return F.transform(
        F.array(words_of(F.coalesce(text, F.lit("")))),
        lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<bigint>")),
    )


def _in(values: set[int]) -> str:
    return ", ".join(f"{_long(v)}" for v in sorted(values))


def _long(v: int) -> str:
    return f"{v}L" if v > -(2**63) else "(-9223372036854775807L - 1L)"


def hits_of(h: str, known: set[int], least: set[int], bands: int) -> Column:
    """Min-hashes of the windows of shingles ``h`` that are pieces' too.

    Where a band agrees, the least shingle of the window is a piece's, so windows without one
    cannot retrieve and are not made.
    """
    width = WINDOW - 1
    places = f"filter(transform({h}, (x, i) -> if(x in ({_in(known)}), i, null)), i -> i is not null)"
    # windows that hold place p begin at multiples of STRIDE from p - width + 1 to p
    starts = f"flatten(transform({places}, p -> sequence(greatest(0, cast(floor((p - {width} + {STRIDE}) / {STRIDE}) as int) * {STRIDE}), cast(floor(p / {STRIDE}) as int) * {STRIDE}, {STRIDE})))"
    windows = f"transform(array_distinct({starts}), i -> slice({h}, i + 1, {width}))"
    mins = f"flatten(transform({windows}, s -> array({', '.join(f'array_min(transform(s, x -> x ^ {_long(m)}))' for m in masks(bands))})))"
    return F.expr(f"array_distinct(filter({mins}, x -> x in ({_in(least)})))")


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | None = None, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """``id_col``, ``text_hash``, ``license``, ``containment``, ``first_word`` of each license in each distinct row."""
    spark = df.sparkSession
    hashed = _hashed(spark, all_templates() if templates is None else templates)
    pieces = [p for r in hashed for p in (_notice_pieces(r, bands) if len(set(r["h"])) <= 63 else _anchors(r, bands))]
    of_least: dict[int, set[int]] = {}
    for p in pieces:
        for x in p["least"]:
            of_least.setdefault(x, set()).add(p["k"])
    keys = sorted(of_least)
    owners = F.expr(f"array({', '.join('array(' + ', '.join(map(str, sorted(of_least[x]))) + ')' for x in keys)})")
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__t"), F.explode(shingles_of(text)).alias("h"))
    # a generator, so that the filter does not compute the hits again
    hit = rows.select("*", F.explode(F.array(hits_of("h", {h for p in pieces for h in p["shingles"]}, set(keys), bands))).alias("hits")).where(F.size("hits") > 0)
    place = F.expr(f"array({', '.join(map(_long, keys))})")
    retrieved = hit.select("__id", "__t", "h", F.array_distinct(F.flatten(F.transform("hits", lambda x: F.get(owners, (F.array_position(place, x) - 1).cast("int"))))).alias("__own"))
    # the places of every shingle of what was retrieved, cut into local runs
    pairs = materialize(spark.createDataFrame([(r["k"], x, len(set(r["h"])), r["h"].index(x) if r["h"].count(x) == 1 else None) for r in hashed for x in set(r["h"])], "k int, x long, size int, nth int"), "license_pairs")
    at = retrieved.select("__id", "__t", "__own", F.posexplode("h").alias("at", "x"))
    held = at.join(F.broadcast(pairs), "x").where("array_contains(__own, k)").select("__id", "__t", "k", "size", "at", "x", "nth").repartition("__id", "__t", "k").distinct()
    order = W.partitionBy("__id", "__t", "k").orderBy("at")
    apart = F.when(F.col("size") > 63, F.greatest(F.lit(WINDOW), F.floor(F.col("size") / 4))).otherwise(F.lit(WINDOW))
    before = F.last("nth", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    again = (F.col("size") <= 63) & (2 * (before - F.col("nth")) > F.col("size"))
    new = (F.col("at") - F.lag("at").over(order) > apart) | F.coalesce(again, F.lit(False))
    cut = held.withColumn("__new", new.cast("int")).withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(order))
    runs = cut.groupBy("__id", "__t", "k", "size", "__run").agg(F.size(F.collect_set("x")).alias("n"), F.collect_list("at").alias("places"))
    names = F.array(*(F.lit(r["name"]) for r in hashed))
    enough = runs.where(F.col("n") / F.col("size") >= containment).select(
        "__id", "__t", F.get(names, F.col("k")).alias("license"), (F.col("n") / F.col("size")).alias("containment"), F.array_min("places").cast("long").alias("first_word"), (F.col("n") * F.col("n") / F.col("size")).alias("rank"), "places"
    )
    # a document's occurrences, few: one stays unless most of its places belong to a better one of another license
    own = enough.groupBy("__id", "__t").agg(F.collect_list(F.struct("license", "containment", "first_word", "rank", "places")).alias("all"))
    best = F.expr("filter(all, x -> not exists(all, y -> y.license <> x.license and y.rank > x.rank and 2 * size(array_intersect(x.places, y.places)) > size(x.places)))")
    single = own.select("__id", "__t", F.inline(best)).groupBy("__id", "__t", "license").agg(F.max_by(F.struct("containment", "first_word"), F.struct("containment", -F.col("first_word"))).alias("b"))
    return single.select(F.col("__id").alias(id_col), F.col("__t").alias("text_hash"), "license", "b.containment", "b.first_word")


def licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every row's ``id_col``, ``n_licenses`` and ``licenses``: names with containments, in order, comma-joined."""
    entry = F.concat_ws(":", "license", F.round("containment", 4).cast("string"))
    found = scan(df, id_col=id_col, text_col=text_col, **how).groupBy(F.col(id_col).alias("__i"), F.col("text_hash").alias("__t")).agg(F.count("*").alias("__n"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("__l"))
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(F.col(text_col).cast("string")).alias("__h"))
    both = rows.join(found, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__t")), "left")
    return both.select(id_col, F.coalesce("__n", F.lit(0)).alias("n_licenses"), F.coalesce("__l", F.lit("")).alias("licenses"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, sf_dir, "documents"))
