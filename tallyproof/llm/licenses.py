"""License scans with DataFrame functions only: text units against license templates by Dice over word bigrams.

Units are the lines of a text, its paragraphs (parted by empty lines) and the whole text. A unit of ``n`` bigrams, repeats counted,
can reach the threshold ``t`` only with templates of ``n * t / (2 - t)`` to ``n * (2 - t) / t`` bigrams: units
outside the sizes of all templates are dropped before their bigrams are made, the others meet only templates of fitting size that
share a bigram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

THRESHOLD = 0.8
#: Templates by SPDX id: notices and headings with which texts name a license, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
]

#: Headers and notices besides; with them each version and family that a notice may name has a template of its own.
NOTICES = TEMPLATES + [
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]
#: Words that tell licenses apart, in lower-case words parted by single spaces.
IDENTITY = r"\b(?:library general|by nc|by sa|by nd|by [1-9]|lesser|affero|later|sa|nc|nd|sharealike|noncommercial|noderivatives|apache|mit|bsd|mozilla|cc0|v?[1-9])\b"


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(unit: Column) -> Column:
    """A word is a run of ASCII letters and digits and non-ASCII characters."""
    return F.array_remove(F.split(F.lower(unit), SEPARATORS), "")


def with_bigrams(df: DataFrame, unit: str) -> DataFrame:
    """Add ``pairs``, the pairs of neighbouring words of a unit."""
    w = df.withColumn("_w", words(F.col(unit)))
    most = F.greatest(F.size("_w") - 1, F.lit(0))
    return w.withColumn("pairs", F.zip_with(F.slice("_w", 1, most), F.slice("_w", 2, most), lambda a, b: F.concat(a, F.lit(" "), b))).drop("_w")


def identity(unit: Column) -> Column:
    """The distinct identifying words of a unit, sorted; ``v3`` and ``3`` are one."""
    found = F.regexp_extract_all(F.array_join(words(unit), " "), F.lit(IDENTITY), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^v", "")))), ",")


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``(license, template, size, pair, uses)`` of a fixed list of templates; those of fewer than two words are left out."""
    listed = spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(rows)], "license string, template int, body string")
    listed = with_bigrams(listed, "body").select("license", "template", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    return listed.groupBy("license", "template", "size", "pair").agg(F.count("*").alias("uses"))


def units(text: Column) -> Column:
    """Distinct lines and paragraphs of a text, and the whole of it."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))


def license_scan(docs: DataFrame, rows: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, alike: bool = False) -> DataFrame:
    """``(doc_id, row, license, template, dice, n_units)``: the templates that units of a document reach, with the best
    score and how many distinct units reach it. Repeated bigrams count as often as they stand in both. ``row`` hashes
    the text. Documents without a match have no row, as have null and empty texts. A null ``doc_id`` stays null. Rows
    that repeat id and text count as one. Case and marks do not matter, the order of words does. With ``alike`` the identifying
    words of a unit must be those of the template, and a unit counts for its best template only (then the longest, then the
    first by name).
    """
    known = templates(docs.sparkSession, rows)
    sizes = known.agg(F.min("size"), F.max("size")).first()
    low, high = (sizes[0] * threshold / (2 - threshold), sizes[1] * (2 - threshold) / threshold) if sizes[0] else (1, 0)
    most = int(high) + 4  # splitting stops here: a unit with so many pieces has too many words
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    short = F.filter(units(F.col("text")), lambda u: F.size(F.split(u, SEPARATORS, most)) < most)
    found = base.select("doc_id", F.xxhash64("text").alias("row"), F.explode(short).alias("unit"))
    found = with_bigrams(found, "unit").withColumn("n", F.size("pairs")).where(F.col("n").between(low, high))
    found = found.withColumn("named", identity(F.col("unit")) if alike else F.lit(""))  # once for each unit, below the explode
    pairs = found.select("doc_id", "row", F.xxhash64("unit").alias("unit"), "n", "named", F.posexplode("pairs").alias("at", "pair"))
    if alike:
        own = docs.sparkSession.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "template int, body string")
        known = known.join(F.broadcast(own.select("template", identity(F.col("body")).alias("name"))), "template")
    else:
        known = known.withColumn("name", F.lit(""))
    fits = (F.col("size") >= F.col("n") * threshold / (2 - threshold)) & (F.col("size") <= F.col("n") * (2 - threshold) / threshold)
    keys = ["doc_id", "row", "unit", "n", "license", "template", "size"]
    shared = pairs.join(F.broadcast(known), "pair").where(fits & (F.col("named") == F.col("name"))).groupBy(*keys, "pair", "uses").agg(F.size(F.collect_set("at")).alias("own"))
    shared = shared.groupBy(*keys).agg(F.sum(F.least("own", "uses")).alias("common"))
    shared = shared.withColumn("dice", F.col("common") * 2.0 / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    if alike:
        best = F.min_by(F.struct("license", "template", "dice"), F.struct(-F.col("dice"), -F.col("size"), F.col("license")))
        shared = shared.groupBy("doc_id", "row", "unit").agg(best.alias("best")).select("doc_id", "row", "best.*")
    return shared.groupBy("doc_id", "row", "license", "template").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"))


def licenses(docs: DataFrame, rows: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, alike: bool = False) -> DataFrame:
    """``(doc_id, license, dice, n_licenses, licenses)``, one row per row of ``docs``: the best match (then the first
    license by name), and all licenses found, sorted. Without a match ``license`` and ``dice`` are null, the list empty."""
    found = license_scan(docs, rows, threshold, alike)
    best = found.groupBy("doc_id", "row").agg(
        F.max(F.struct("dice")).alias("top"), F.min_by("license", F.struct(-F.col("dice"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set("license")).alias("licenses"))
    best = best.select(F.col("doc_id").alias("f_id"), "row", "license", F.col("top.dice").alias("dice"), "licenses")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("f_row"))
    both = base.join(best.hint("merge"), base.doc_id.eqNullSafe(best.f_id) & (F.col("f_row") == F.col("row")), "left")
    listed = F.coalesce("licenses", F.array().cast("array<string>"))
    return both.select("doc_id", "license", "dice", F.size(listed).cast("bigint").alias("n_licenses"), listed.alias("licenses"))
