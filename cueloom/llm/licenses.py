"""Licence scans: sparse TF-IDF cosine against templates, then inheritance from directories.

Passages of a file that speak of a licence, lines and the sentences of a line, are compared
with licence templates. The templates are a bounded table of this module, so their vectors are
literals of the plan: scoring a file takes no join and no shuffle. A file without a licence of
its own takes that of the nearest ancestor directory that has a licence file, found by joins of
directory paths. Distinct directories are resolved first; files meet them by one equi-join.

Weights of terms are integers and cosines compare exact integers, so results do not depend on
the order of sums.

Defined results: a null or empty text has no licence of its own; a very long text is scanned whole, and only its
passages that speak of a licence are scored; a null path has no
directory and inherits nothing; repeated rows are scanned one by one; of templates that tie for a file the first
counts; several licence files in one directory: the best score, then the licence name that sorts last, counts; an empty table gives an empty
result; columns of files that have the name of an output column are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Notices of well-known licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain, CC0 1.0 Universal."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = r"(?i)licen[cs]e|copyright|redistribution|public domain|permission is hereby|permission to use|rights reserved|creative commons"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
TERM_RE = "[^a-z0-9.]+|\\.+(?![a-z0-9])"
#: A passage is of a licence from this cosine on.
LEAST = 0.6
#: A text whose passages hold this share of its characters is itself a licence file.
FILE_SHARE = 0.5


def _terms(text: str) -> list[str]:
    return [t for t in re.split(TERM_RE, text.lower()) if t]


def _weights() -> tuple[dict[str, int], int]:
    df = Counter(t for _, x in TEMPLATES for t in set(_terms(x)))
    idf = lambda n: round(100 * (math.log((len(TEMPLATES) + 1) / (n + 1)) + 1))
    return {t: idf(n) for t, n in sorted(df.items())}, idf(0)


IDF, IDF_NEW = _weights()
VECTORS = [{t: n * IDF[t] for t, n in sorted(Counter(_terms(x)).items())} for _, x in TEMPLATES]
NORMS = [sum(v * v for v in x.values()) for x in VECTORS]


def _map(d: dict[str, int]) -> Column:
    return F.create_map(*[y for k, v in d.items() for y in (F.lit(k), F.lit(v).cast("long"))])


def _best(passage: Column) -> Column:
    """struct<score, no>: the template of highest cosine; score as a double."""

    def score(terms: Column) -> Column:
        uniq = F.array_distinct(terms)
        counted = F.transform(uniq, lambda t: F.struct(t.alias("t"), F.size(F.filter(terms, lambda x: x == t)).cast("long").alias("n")))

        def against(tf: Column) -> Column:
            idf = _map(IDF)
            weight = lambda x: x["n"] * F.coalesce(F.try_element_at(idf, x["t"]), F.lit(IDF_NEW))
            norm = F.aggregate(tf, F.lit(0).cast("long"), lambda a, x: a + weight(x) * weight(x))

            def cosine(no: int) -> Column:
                vector = _map(VECTORS[no])
                dot = F.aggregate(tf, F.lit(0).cast("long"), lambda a, x: a + weight(x) * F.coalesce(F.try_element_at(vector, x["t"]), F.lit(0).cast("long")))
                return let(F.struct(dot.alias("d"), norm.alias("n")), lambda y: F.when(y["n"] > 0, F.round(y["d"] / F.sqrt(y["n"].cast("double") * F.lit(float(NORMS[no]))), 9)).otherwise(0.0))

            return reduce(
                lambda a, b: F.greatest(a, b),
                [F.struct(cosine(no).alias("score"), F.lit(-no).alias("no")) for no in range(len(TEMPLATES))],
            )

        return let(counted, against)

    return let(F.filter(F.split(F.lower(passage), TERM_RE), lambda t: t != ""), score)


def own_license(text: Column) -> Column:
    """struct<license, score, share>: of the best passage of the whole text, and the share of the
    text's characters that stand in licence passages."""
    whole = F.coalesce(text, F.lit(""))

    def of(lines: Column) -> Column:
        scored = F.transform(lines, lambda x: F.struct(_best(x).alias("b"), F.length(x).alias("n")))

        def pick(s: Column) -> Column:
            best = F.array_max(F.transform(s, lambda x: x["b"]))
            hit = F.filter(s, lambda x: x["b"]["score"] >= LEAST)
            covered = F.aggregate(hit, F.lit(0), lambda a, x: a + x["n"])
            names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
            good = best["score"] >= LEAST
            return F.struct(
                F.when(good, F.get(names, -best["no"])).alias("license"),
                F.when(good, best["score"]).alias("score"),
                F.when(good, covered / F.length(whole)).alias("share"),
            )

        return let(scored, pick)

    none = F.lit(None)
    nothing = F.struct(none.cast("string").alias("license"), none.cast("double").alias("score"), none.cast("double").alias("share"))
    # a line is cut into sentences, so that a notice inside a long line is compared alone
    passages = F.filter(F.split(whole, r"\n|(?<=[.!?])\x20+(?=[A-Z])"), lambda x: x.rlike(CUE))
    return F.when(whole.rlike(CUE), let(passages, of)).otherwise(nothing)


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files without the text, with license, score, inherited and license_from.

    license_from: the path's directory that the licence comes from, null for a file's own.
    """
    new = ["license", "score", "inherited", "license_from", "own"]
    rest = [c for c in files.columns if c != text and c not in new]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    p = F.col(f"row.`{path}`")
    directory = F.when(p.contains("/"), F.regexp_extract(p, "^(.*)/[^/]*$", 1)).when(p.isNotNull(), "")
    scored = files.select(row.alias("row"), own_license(F.col(f"`{text}`")).alias("own")).withColumn("__dir", directory)

    declares = F.col("own.license").isNotNull() & (p.rlike(LICENSE_FILE) | (F.col("own.share") >= FILE_SHARE))
    declared = scored.filter(declares & F.col("__dir").isNotNull()).groupBy(F.col("__dir").alias("anc")).agg(
        F.max_by(F.struct("own.license", "own.score"), F.struct(F.col("own.score"), F.col("own.license"))).alias("from")
    )
    # every directory with files, with its ancestors, itself at depth 0
    dirs = scored.select("__dir").filter(F.col("__dir").isNotNull()).distinct()
    parts = F.when(F.col("__dir") == "", F.array().cast("array<string>")).otherwise(F.split("__dir", "/"))
    dirs = dirs.withColumn("__parts", parts)
    ancestors = dirs.select(
        "__dir",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size("__parts")),
                lambda i: F.array_join(F.slice(F.col("__parts"), 1, F.size("__parts") - i), "/"),
            )
        ).alias("up", "anc"),
    )
    nearest = ancestors.join(declared, "anc").groupBy("__dir").agg(F.min_by(F.struct("from", "anc"), "up").alias("near"))
    joined = scored.join(nearest, "__dir", "left")
    own = F.col("own.license").isNotNull()
    return joined.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest],
        F.coalesce("own.license", "near.from.license").alias("license"),
        F.coalesce("own.score", "near.from.score").alias("score"),
        (~own & F.col("near").isNotNull()).alias("inherited"),
        F.when(~own, F.col("near.anc")).alias("license_from"),
    )


def _literal_table() -> str:
    rows = ", ".join(f"({no}, '{n}', '{t}', {w}::BIGINT, {NORMS[no]}::DOUBLE)" for no, (n, _) in enumerate(TEMPLATES) for t, w in VECTORS[no].items())
    idf = ", ".join(f"('{t}', {w}::BIGINT)" for t, w in IDF.items())
    return f"tmpl(no, name, term, w, norm) AS (VALUES {rows}), idf(term, i) AS (VALUES {idf})"


def oracle(path_sql: str) -> str:
    """DuckDB SQL of scan() over documents, with the path as given."""
    return f"""
WITH {_literal_table()},
f AS (SELECT doc_id, {path_sql} AS path, coalesce(text, '') AS text FROM documents),
pas AS (SELECT doc_id, length(text) AS len, unnest(p) AS x, unnest(range(len(p))) AS k FROM (
  SELECT doc_id, text, string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])\\x20+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM f)),
cue AS (SELECT * FROM pas WHERE regexp_matches(x, '{CUE.replace("(?i)", "")}', 'i')),
tok AS (SELECT doc_id, k, t, count(*) AS n FROM (SELECT doc_id, k, unnest(string_split_regex(regexp_replace(lower(x) || ' ', '\\.+([^a-z0-9])', ' \\1', 'g'), '[^a-z0-9.]+')) AS t FROM cue) WHERE t <> '' GROUP BY ALL),
wt AS (SELECT doc_id, k, t, n * coalesce(i, {IDF_NEW}) AS w FROM tok LEFT JOIN idf ON term = t),
nrm AS (SELECT doc_id, k, sum(w * w)::DOUBLE AS pn FROM wt GROUP BY ALL),
cs AS (SELECT doc_id, k, no, any_value(name) AS name, round(sum(wt.w * tmpl.w)::BIGINT / sqrt(any_value(pn) * any_value(norm)), 9) AS score
  FROM wt JOIN tmpl ON t = term JOIN nrm USING (doc_id, k) GROUP BY doc_id, k, no),
hit AS (SELECT * FROM cs WHERE score >= {LEAST}),
shr AS (SELECT doc_id, sum(length(x)) / any_value(len) AS share FROM cue WHERE EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = cue.doc_id AND hit.k = cue.k) GROUP BY doc_id),
own AS (SELECT doc_id, name AS license, score, share FROM hit JOIN shr USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no) = 1),
g AS (SELECT f.doc_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir, license, score, share FROM f LEFT JOIN own USING (doc_id)),
dec AS (SELECT dir AS anc, license AS l, score AS s FROM g WHERE license IS NOT NULL AND (regexp_matches(path, '{LICENSE_FILE.replace("(?i)", "")}', 'i') OR share >= {FILE_SHARE})
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license DESC) = 1),
near AS (SELECT d.dir, anc, l, s FROM (SELECT DISTINCT dir FROM g) d JOIN dec ON d.dir = anc OR starts_with(d.dir, anc || '/') OR anc = ''
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(anc) DESC) = 1)
SELECT doc_id, path, coalesce(license, l) AS license, coalesce(score, s) AS score, license IS NULL AND near.dir IS NOT NULL AS inherited,
  CASE WHEN license IS NULL THEN anc END AS license_from FROM g LEFT JOIN near USING (dir)
"""
