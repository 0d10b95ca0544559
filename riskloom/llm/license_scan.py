"""Licence scan by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame operations only. Every line of every file, and every run of up to ``window`` consecutive lines, is compared with
the templates, as the set of its terms. The inverse document frequency of a term counts the lines of the whole corpus that
hold it. A unit can only reach the threshold with a template if it holds one of that template's heaviest terms (prefix
principle: without them the remaining mass is below threshold), and only if it would reach it were its terms outside the
templates as light as a term can be (weight 1). The terms of such units, once per distinct set, are joined to their
frequencies; the scores are then exact.

``TEMPLATES`` has one notice a licence; ``FORMS`` has the usual forms of each, with ranks: a bare reservation of rights, which
also stands above many open licences, speaks only where the file names no licence, and the opening that the BSD licences
share yields to the clause that only one of them has.

A file's own licence is that of its best unit: of the highest rank, then the highest cosine. A licence file (by its base name) speaks for its directory; every file
without own licence takes the one of the nearest ancestor directory that has one. That join is between distinct
directories and their ancestors, not files, so a root directory that all files share is one row.

The templates are a parameter of few rows, held as literals; their terms are at most some hundreds (checked).

Defined results: null or empty text has no licence of its own but may inherit; of one rank, ties go to the higher cosine, then
the template name, then the file path; a null path has no ancestors; repeated rows are kept each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

# Short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under Creative Commons Zero 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved. Confidential and proprietary.",
}
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
EDITIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
GNU_GRANT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
# (licence, rank, text): the usual forms, longer texts by their openings.
FORMS = [
    *((name, 1 if name.startswith("BSD") else 2, text) for name, text in TEMPLATES.items()),
    ("AGPL-3.0", 2, GNU_GRANT.format("Affero General Public License", "3")),
    ("AGPL-3.0", 2, "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", 2, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 2, "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", 1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", 2, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", 2, "Licensed under CC0 1.0."),
    ("CC0-1.0", 2, "Creative Commons CC0 1.0 Universal"),
    *((f"CC-{code}-{v}", 2, f"Licensed under CC {code} {v}.") for code in CREATIVE_COMMONS for v in EDITIONS),
    *((f"CC-{code}-{v}", 2, f"This work is licensed under a Creative Commons {name} {v} {edition} License.") for code, name in CREATIVE_COMMONS.items() for v, edition in EDITIONS.items()),
    ("GPL-2.0", 2, GNU_GRANT.format("General Public License", "2")),
    ("GPL-2.0", 2, "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", 2, GNU_GRANT.format("General Public License", "3")),
    ("GPL-3.0", 2, "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", 2, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", 2, GNU_GRANT.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", 2, "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", 2, GNU_GRANT.format("Lesser General Public License", "3")),
    ("LGPL-3.0", 2, "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", 2, "Licensed under the MIT License."),
    ("MIT", 2, "The MIT License (MIT)"),
    ("MIT", 2, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MPL-2.0", 2, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", 2, "Mozilla Public License Version 2.0"),
    ("Proprietary", 0, "All rights reserved."),
    ("Proprietary", 0, "Copyright (c) All rights reserved."),
    ("Unlicense", 2, "This is free and unencumbered software released into the public domain."),
]
WINDOW = 4
THRESHOLD = 0.7
MAX_TERMS = 2000
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"


def terms(line: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", line.lower())


def _array(values) -> F.Column:
    """Strings without blanks as one literal: a long list of literals makes plans slow."""
    return F.split(F.lit(" ".join(values)), " ")


def line_terms(text) -> F.Column:
    """Distinct lines of a text as structs of their distinct terms; vectors are binary in the line, so counts don't matter."""
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.array_distinct(F.filter(F.split(x, "[^a-z0-9]+"), lambda t: t != "")))


def runs_of_lines(bags: F.Column, hits: F.Column, window: int) -> F.Column:
    """The terms of each run of 1 to ``window`` consecutive lines of which at least one is a hit."""

    def of(length: int) -> F.Column:
        starts = F.when(F.size(bags) >= length, F.sequence(F.lit(1), F.size(bags) - (length - 1)))
        hit = F.filter(starts, lambda i: F.exists(F.slice(hits, i, length), lambda h: h))
        return F.coalesce(F.transform(hit, lambda i: F.array_distinct(F.flatten(F.slice(bags, i, length)))), F.array().cast("array<array<string>>"))

    return F.concat(*[of(k) for k in range(1, window + 1)])


def scan(files: DataFrame, templates: dict[str, str] | list[tuple[str, int, str]] = TEMPLATES, threshold: float = THRESHOLD, window: int = 1) -> DataFrame:
    """(path, license, score): the best unit of each file of (path, text) that reaches the threshold."""
    listed = [(name, 0, x) for name, x in templates.items()] if isinstance(templates, dict) else templates
    forms = [(name, rank, sorted(set(terms(x)))) for name, rank, x in sorted(listed)]
    vocabulary = sorted({t for *_, bag in forms for t in bag})
    if not 0 < len(vocabulary) <= MAX_TERMS:
        raise ValueError(f"templates have {len(vocabulary)} terms; 1 to {MAX_TERMS} are held as literals")
    known = _array(vocabulary)
    lines = files.select(F.explode(line_terms(F.col("text"))).alias("all"))
    counts = materialise(lines.select(F.explode("all").alias("t")).groupBy("t").agg(F.count("*").alias("lines")), "term_lines")
    frequency = {r["t"]: r["lines"] for r in counts.where(F.col("t").isin(vocabulary)).collect()}  # at most MAX_TERMS rows
    total = files.select(F.sum(F.size(F.split(F.col("text"), "\n"))).alias("n")).first()["n"] or 0
    idf = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
    norms = [math.sqrt(sum(idf[t] ** 2 for t in bag)) for *_, bag in forms]

    needed: set[str] = set()
    for (*_, bag), norm in zip(forms, norms, strict=True):  # the heaviest terms without which the rest of the template has a cosine below the threshold
        rest = sum(idf[t] ** 2 for t in bag)
        for t in sorted(bag, key=lambda t: (-idf[t], t)):
            if math.sqrt(rest) / norm < threshold:
                break
            needed.add(t)
            rest -= idf[t] ** 2
    by_line = files.select("path", line_terms(F.col("text")).alias("bags"))
    marked = by_line.withColumn("hits", F.transform("bags", lambda b: F.arrays_overlap(b, _array(sorted(needed))))).where(F.exists("hits", lambda h: h))
    units = marked.select("path", F.explode(runs_of_lines(F.col("bags"), F.col("hits"), window)).alias("all"))
    bag_of = units.select("path", F.array_intersect("all", known).alias("terms"), F.array_sort(F.array_except("all", known)).alias("others"))

    weight = F.map_from_arrays(known, _array([repr(idf[t] ** 2) for t in vocabulary]).cast("array<double>"))
    mass_of = lambda found: F.aggregate(found, F.lit(0.0), lambda a, t: a + F.element_at(weight, t))
    # as dot <= square and dot <= norm ** 2, the cosine is at most the root of the templates' terms' share of the unit
    reaches = lambda rest: F.col("square") >= (threshold - 1e-8) ** 2 * (F.col("square") + rest)
    sized = bag_of.withColumn("square", mass_of(F.col("terms"))).where(reaches(F.size("others")))
    sized = materialise(sized.withColumn("key", F.unhex(F.sha2(F.array_join("others", " ").cast("binary"), 256))), "licence_lines")  # short, as it goes with every term
    each = sized.select("key", "others").dropDuplicates(["key"]).select("key", F.explode("others").alias("term"))
    seen = F.log(F.lit(1.0 + total) / (1 + F.col("lines"))) + 1
    mass = each.join(counts, F.col("term") == F.col("t")).groupBy("key").agg(F.sum(seen * seen).alias("mass")).withColumnRenamed("key", "k")
    weighed = sized.drop("others").join(mass, F.col("key") == F.col("k"), "left").withColumn("mass", F.coalesce("mass", F.lit(0.0))).where(reaches(F.col("mass")))

    # of equal scores the first template by name wins
    columns = [[name for name, *_ in forms], [str(rank) for _, rank, _ in forms], [repr(x) for x in norms], [" ".join(bag) for *_, bag in forms], [str(-i) for i in range(len(forms))]]
    name, rank, norm, bag, order = (F.split(F.lit("\n".join(x)), "\n") for x in columns)
    held = F.arrays_zip(name.alias("license"), rank.cast("array<int>").alias("rank"), norm.cast("array<double>").alias("norm"), bag.alias("bag"), order.cast("array<int>").alias("order"))
    cosine = lambda f: F.round(mass_of(F.array_intersect(F.col("terms"), F.split(f["bag"], " "))) / (F.sqrt(F.col("square") + F.col("mass")) * f["norm"]), 9)
    scored = F.transform(held, lambda f: F.struct(f["rank"].alias("rank"), cosine(f).alias("score"), f["order"].alias("order"), f["license"].alias("license")))
    found = weighed.select("path", F.explode(F.filter(scored, lambda x: x["score"] >= threshold)).alias("b")).groupBy("path").agg(F.max("b").alias("b"))
    return found.select("path", F.col("b.license").alias("license"), F.col("b.score").alias("score"))


def ancestors(directory) -> F.Column:
    """The directory itself and all above it, as (depth, directory); the root is the empty directory at depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    depths = F.sequence(F.lit(0), F.size(parts))
    return F.transform(depths, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))


def inherit(files: DataFrame, own: DataFrame, license_file: str = LICENSE_FILE) -> DataFrame:
    """All columns of the files with license, score, inherited_license, inherited_from (a directory)."""
    directory = F.array_join(F.slice(F.filter(F.split("path", "/"), lambda x: x != ""), F.lit(1), F.greatest(F.size(F.filter(F.split("path", "/"), lambda x: x != "")) - 1, F.lit(0))), "/")
    name = F.element_at(F.split("path", "/"), -1)
    own = own.select(F.col("path").alias("_path"), "license", "score")
    joined = files.withColumn("_dir", directory).join(own, F.col("path") == F.col("_path"), "left").drop("_path")
    rank = Window.partitionBy("_dir").orderBy(F.desc("score"), "license", "path")
    speaking = joined.where(F.col("license").isNotNull() & name.rlike(license_file)).select("_dir", "license", "score", "path").distinct()
    speaking = materialise(
        speaking.withColumn("r", F.row_number().over(rank)).where("r = 1").select(F.col("_dir").alias("from_dir"), F.col("license").alias("inherited_license")), "licence_dirs"
    )
    directories = files.select(directory.alias("d")).where("d is not null").distinct()
    up = directories.select("d", F.explode(ancestors(F.col("d"))).alias("a")).select("d", F.col("a.depth").alias("depth"), F.col("a.dir").alias("dir"))
    nearest = up.join(speaking, F.col("dir") == F.col("from_dir")).groupBy("d").agg(F.max(F.struct("depth", "from_dir", "inherited_license")).alias("x"))
    nearest = nearest.select("d", F.col("x.from_dir").alias("inherited_from"), F.col("x.inherited_license").alias("inherited_license"))
    out = joined.join(nearest, F.col("_dir") == F.col("d"), "left").drop("d", "_dir")
    without = F.col("license").isNull()
    return out.withColumn("inherited_license", F.when(without, F.col("inherited_license"))).withColumn("inherited_from", F.when(without, F.col("inherited_from")))
