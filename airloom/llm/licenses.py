"""License notices inside documents, retrieved by MinHash and verified by shingle containment.

A text is read as overlapping windows of WINDOW shingles, a shingle being five words. Each window has
BANDS minhashes, one row to a band; so has each template. A window inside a notice that holds the
template's smallest shingle of a band has the same minhash, whatever stands elsewhere; the windows
overlap so that each shingle but a notice's only one lies in such a window. ``found_at_least`` gives
the resulting probability. A template of fewer than five words is one shingle of all its words; a text
is also read as shingles of that many words, and those equal to a short template are found without
minhashes, all of them. Everything is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm.frames import text_of
from airloom.session import settled

SHINGLE = 5
WINDOW = 2
BANDS = 8
CONTAINED = 0.8

#: Notices as their publishers word them; (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
     "option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

#: Identifiers that source files name on a line of their own.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later",
    "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Zlib", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0",
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in SPDX)

#: Templates, and their words, that are compared in one pass over the texts; longer lists take more.
SLICE_TEMPLATES = 5_000
SLICE_WORDS = 500_000


def found_at_least(shingles: int, contained: float = CONTAINED, bands: int = BANDS) -> float:
    """The probability that a notice of a template with so many shingles is retrieved.

    In one band a notice that contains a share of the template's shingles has the smallest of them
    with that probability. A window then shows it unless its other shingle is smaller: with a
    neighbour inside the notice never, for a template of one shingle in both windows with 1/3.
    """
    band = contained if shingles > 1 else 2 / 3
    return 1 - (1 - band) ** bands


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), "")


def _hashed(text: Column) -> Column:
    """A hash for each word of a text."""
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words in order, from the words' hashes."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, every).otherwise(F.array().cast("array<long>"))


def _salt(band: int) -> int:
    return int.from_bytes(hashlib.sha256(b"band %d" % band).digest()[:8], "big", signed=True)


def _minhashes(hashes: Column, band: int) -> Column:
    """The smallest salted hash of each window of WINDOW shingles; the last windows are shorter."""
    salted = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_salt(band))))
    return F.transform(F.array(salted), lambda s: F.transform(
        s, lambda h, i: F.least(h, *[F.get(s, i + k) for k in range(1, WINDOW)])
    ))[0]


def _hits(hashes: Column, band: int, wanted: list[int]) -> Column:
    """(band, at, minhash) of the windows that share a minhash with any template."""
    marked = F.transform(_minhashes(hashes, band), lambda v, i: F.struct(F.lit(band).alias("band"), i.alias("at"), v.alias("minhash")))
    return F.filter(marked, lambda w: w["minhash"].isin(*wanted))


def _least(hashes: str, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_salt(band)))))


def templates(spark: SparkSession, texts: Sequence[tuple[str, str]] = TEMPLATES, first: int = 0) -> DataFrame:
    """(template, license, size, parts, minhashes): the different shingles of each notice, all of ``size`` words, and the least of each band."""
    if not texts:
        raise ValueError("there are no templates to scan for")
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
                     for n, (name, text) in enumerate(texts, first)])
    listed = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.license", _hashed(F.col("t.text")).alias("words"))
    listed = listed.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE))).where(F.col("size") > 0)
    cases = F.array_distinct(_runs(F.col("words"), SHINGLE))
    for n in range(1, SHINGLE):
        cases = F.when(F.col("size") == n, _runs(F.col("words"), n)).otherwise(cases)
    listed = listed.select("template", "license", "size", cases.alias("parts"))
    return listed.select("*", F.array(*[_least("parts", b) for b in range(BANDS)]).alias("minhashes"))


def _slices(texts: Sequence[tuple[str, str]]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """The list in parts of bounded size, with the number of the first of each."""
    part, words, first = [], 0, 0
    for n, entry in enumerate(texts):
        size = len(entry[1].split())
        if part and (len(part) >= SLICE_TEMPLATES or words + size > SLICE_WORDS):
            yield first, part
            part, words, first = [], 0, n
        part.append(entry)
        words += size
    yield first, part


def license_notices(
    docs: DataFrame, id: str = "doc_id", text: str = "text", texts: Sequence[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED
) -> DataFrame:
    """(id, license, template, containment) of each notice found in each document, the best of each template.

    A window of a document retrieves the templates with which it shares a minhash in a band. Verified
    are the shingles around it, one template's length to either side: the share of the template's
    different shingles among them must reach ``contained``. A template of fewer than SHINGLE words is
    found wherever its words follow each other. Null and empty texts hold nothing; rows that repeat an
    id are one document; null ids are one document; repeated notices count once. Texts are taken
    whole; a text and its hashes must fit into a task's memory. A list of any length is scanned for,
    in slices, one pass over the texts each.
    """
    found = reduce(DataFrame.unionByName, [_notices(docs, id, text, part, first, contained) for first, part in _slices(texts)])
    return found.groupBy(F.col("id").alias(id), "license", "template").agg(F.max("containment").alias("containment"))


def _notices(docs: DataFrame, id: str, text: str, texts: Sequence[tuple[str, str]], start: int, contained: float) -> DataFrame:
    known = settled(templates(docs.sparkSession, texts, start), "templates")
    keys = known.select("size", "parts", "minhashes").collect()  # at most SLICE_TEMPLATES rows
    long = [k.minhashes for k in keys if k.size == SHINGLE]
    short = {n: sorted({k.parts[0] for k in keys if k.size == n}) for n in sorted({k.size for k in keys} - {SHINGLE})}

    def read(words: Column) -> Column:
        exact = [F.array_distinct(F.filter(_runs(words, n), lambda h: h.isin(*wanted))) for n, wanted in short.items()]
        return F.struct(_runs(words, SHINGLE).alias("hashes"), F.concat(F.array().cast("array<long>"), *exact).alias("exact"))

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.transform(F.array(_hashed(text_of(text))), read)[0].alias("r")).select("id", "r.*")
    hit = [_hits(F.col("hashes"), b, sorted({m[b] for m in long})) for b in range(BANDS) if long]
    hit.append(F.transform("exact", lambda h: F.struct(F.lit(BANDS).alias("band"), F.lit(0).alias("at"), h.alias("minhash"))))
    near = rows.select("id", "hashes", F.explode(F.concat(*hit)).alias("w")).select("id", "hashes", "w.*")
    # short templates have one band of their own, after the others, with the shingle itself
    listed = F.transform("minhashes", lambda m, b: F.struct(b.alias("of_band"), m.alias("of_minhash")))
    alone = F.array(F.struct(F.lit(BANDS).alias("of_band"), F.col("parts")[0].alias("of_minhash")))
    listed = F.when(F.col("size") < SHINGLE, alone).otherwise(listed)
    banded = known.select("template", F.explode(listed).alias("b")).select("template", "b.*")
    found = near.join(F.broadcast(banded), (F.col("band") == F.col("of_band")) & (F.col("minhash") == F.col("of_minhash")))
    found = found.join(F.broadcast(known.select("template", "license", "parts")), "template")  # both at most a slice
    first = F.greatest(F.col("at") + 2 - F.size("parts"), F.lit(1))
    around = F.slice("hashes", first, F.col("at") + WINDOW + F.size("parts") - first)
    share = F.when(F.col("band") == BANDS, 1.0).otherwise(F.size(F.array_intersect("parts", around)) / F.size("parts"))
    return found.select("id", "license", "template", share.alias("containment")).where(F.col("containment") >= contained)
