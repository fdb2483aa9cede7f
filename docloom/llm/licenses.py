"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then the nearest directory's licence."""

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

#: The usual notices and titles by which files name their licence.
TEMPLATES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU Affero General Public License, version 3 or later", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "Apache-2.0 WITH Commons-Clause": ["Apache License, Version 2.0, with Commons Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "SPDX-License-Identifier: BSD-3-Clause"],
    "BUSL-1.1": ["Business Source License 1.1", "SPDX-License-Identifier: BUSL-1.1"],
    "CC-BY-3.0": ["Licensed under CC BY 3.0", "Licensed under a Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0", "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0", "Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "Elastic-2.0": ["Elastic License 2.0", "SPDX-License-Identifier: Elastic-2.0"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2", "GPL, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-2.0-or-later": ["GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "GNU General Public License, version 2 or later", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3", "GPL, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-3.0-or-later": ["GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU General Public License, version 3 or later", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "GNU Lesser General Public License, version 2.1 or later", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3", "LGPL, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU Lesser General Public License, version 3 or later", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "SSPL-1.0": ["Server Side Public License, version 1", "SPDX-License-Identifier: SSPL-1.0"],
}

TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Where a licence may be named.
HEADER = r"(?i)licen[sc]e|copyright|spdx|public domain|permission (?:is hereby granted|to use)|redistribution and use in source|names of its contributors|cc0 1|\b[al]?gpl\b"
#: A term that only stands where HEADER may match: runs of other terms are laid round it.
KEY = r"licen[sc]e|copyright|^spdx$|^domain$|^permission$|^redistribution$|^contributors$|^cc0$|^[al]?gpl$"
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[.\-_].*)?$"
LEAST_COSINE = 0.7
#: Terms that make another licence of one that reads nearly alike; these and version numbers have to be the template's own.
QUALIFIERS = {
    "affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "library": "library", "later": "later", "noncommercial": "noncommercial", "nc": "noncommercial",
    "apache": "apache", "mozilla": "mozilla", "mpl": "mozilla", "elastic": "elastic", "business": "business", "busl": "business", "server": "server", "sspl": "server",
    "noderivatives": "noderivatives", "noderivs": "noderivatives", "nd": "noderivatives", "sharealike": "sharealike", "sa": "sharealike",
}
VERSION = r"^v?([0-9]{1,2}(?:\.[0-9]+)*?)(?:\.0)*$"
#: Terms before and behind a run that belong to it: the kind of a public licence, and what says that later versions will do.
LEAD, TRAIL = 6, 10
#: What stands before a run and changes what it says: another kind of licence, or that it isn't meant.
LEADS = ("affero", "lesser", "library", "server", "not")
#: Terms in or behind a run that restrict the licence it names, and the qualifier for them.
CLAUSE, CLAUSED = r"\bcommons clause\b", "commonsclause"
LATER = r"^(?:of (?:the|this) license )?or (?:at your option )?(?:any )?(?:later|newer)"


def terms_of(text: str) -> list[str]:
    """Lower-cased terms, versions without v and closing zeros."""
    return [re.sub(VERSION, r"\1", t) for t in re.findall(TERM, text.lower())]


def qualifiers(terms: list[str]) -> str:
    """The distinct qualifiers and versions among the terms, sorted, with a blank between."""
    found = {QUALIFIERS[t] for t in terms if t in QUALIFIERS} | {m[1] for t in terms if (m := re.match(VERSION, t))}
    found |= {CLAUSED} if re.search(CLAUSE, " ".join(terms)) else set()
    return " ".join(sorted(found))


def _qualifiers(terms: Column) -> Column:
    word = lambda t: F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in QUALIFIERS.items()])
    own = lambda t: F.coalesce(word(t), F.when(t.rlike(VERSION), F.regexp_extract(t, VERSION, 1)))
    return F.array_compact(F.transform(terms, own))


def template_weights() -> tuple[list[tuple[str, int, str, float]], float]:
    """((licence, template, term, weight of unit length), the inverse document frequency of terms in no template)."""
    texts = [(name, i, terms_of(text)) for name, own in TEMPLATES.items() for i, text in enumerate(own)]
    n = len(texts)
    held: dict[str, int] = {}
    for _, _, terms in texts:
        for t in set(terms):
            held[t] = held.get(t, 0) + 1
    idf = {t: math.log(1 + n / k) for t, k in held.items()}
    rows = []
    for name, i, terms in texts:
        tf = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(w * w for w in tf.values()))
        rows += [(name, i, t, w / norm) for t, w in tf.items()]
    return rows, math.log(1 + n)


def _weights(spark: SparkSession) -> tuple[DataFrame, DataFrame, float]:
    """(licence, template, qualifiers, term, weight), (term, idf), and the idf of all other terms; as large as TEMPLATES."""
    rows, rare = template_weights()
    held: dict[str, set] = {}
    for name, i, t, _ in rows:
        held.setdefault(t, set()).add((name, i))
    n = sum(map(len, TEMPLATES.values()))
    rows = [(name, i, qualifiers(terms_of(TEMPLATES[name][i])), t, w) for name, i, t, w in rows]
    weights = spark.createDataFrame(rows, "licence string, template int, qualifiers string, term string, weight double")
    idf = spark.createDataFrame([(t, math.log(1 + n / len(k))) for t, k in held.items()], "term string, idf double")
    return weights, idf, rare


def runs(texts: DataFrame) -> DataFrame:
    """(row, place, length, run, qualifiers) of (row, text): the runs of terms over a key that begin and end with a template's
    term or a version and are as long as a template may be. A version counts the same with and without v and closing zeros.

    Line ends and comment marks don't count, so wrapped notices and notices inside of lines are found alike; the best run
    for a template begins and ends with its terms. qualifiers are the run's own and those that stand right before or
    behind it. A text takes rows in proportion to its keys.
    """
    own = [terms_of(t) for texts in TEMPLATES.values() for t in texts]
    least, most = min(map(len, own)), max(map(len, own))
    vocabulary = F.array(*[F.lit(t) for t in sorted({t for terms in own for t in terms})])
    terms = texts.where(F.col("text").rlike(HEADER)).select("row", F.expr(f"regexp_extract_all(lower(text), '{TERM}', 0)".replace("\\", "\\\\")).alias("terms"))
    terms = terms.withColumn("terms", F.transform("terms", lambda t: F.regexp_replace(t, VERSION, "$1")))
    places = F.filter(F.transform("terms", lambda t, i: F.when(t.rlike(KEY), i)), lambda i: i.isNotNull())
    # A run is taken at its first key, so once: it begins behind the key before that.
    keys = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.when(i > 0, F.get("keys", i - 1)).otherwise(-1).alias("before")))
    near = terms.withColumn("keys", places).select("row", "terms", F.explode(keys).alias("k")).select("row", "terms", "k.*")
    begin = F.greatest(F.col("key") - (most - 1) - LEAD, F.lit(0))
    near = near.select("row", begin.alias("begin"), (F.col("before") - begin).alias("before"), F.slice("terms", begin + 1, 2 * most - 1 + LEAD + TRAIL).alias("near"), (F.col("key") - begin).alias("key"))
    known = F.filter(F.transform("near", lambda t, i: F.when(F.array_contains(vocabulary, t) | t.rlike(VERSION), i)), lambda i: i.isNotNull())
    near = near.withColumn("known", known).select("row", "begin", "near", "key", "known", F.explode(F.filter("known", lambda i: (i <= F.col("key")) & (i > F.col("before")))).alias("first"))
    near = near.select("row", "begin", "near", "key", "first", F.explode("known").alias("last"))
    length = F.col("last") - F.col("first") + 1
    near = near.where((F.col("last") >= F.col("key")) & length.between(least, most))
    run = F.slice("near", F.col("first") + 1, F.greatest(length, F.lit(0)))
    lead = F.filter(F.slice("near", F.greatest(F.col("first") - LEAD, F.lit(0)) + 1, F.least("first", F.lit(LEAD))), lambda t: t.isin(*LEADS))
    later = F.when(F.array_join(F.slice("near", F.col("last") + 2, TRAIL), " ").rlike(LATER), F.array(F.lit("later"))).otherwise(F.array().cast("array<string>"))
    behind = F.array_join(F.slice("near", F.col("first") + 1, F.greatest(length, F.lit(0)) + TRAIL), " ")
    clause = F.when(behind.rlike(CLAUSE), F.array(F.lit(CLAUSED))).otherwise(F.array().cast("array<string>"))
    found = F.array_join(F.array_sort(F.array_distinct(F.concat(_qualifiers(run), lead, later, clause))), " ")
    return near.select("row", (F.col("begin") + F.col("first")).alias("place"), length.alias("length"), run.alias("run"), found.alias("qualifiers"))


def best_licence(pieces: DataFrame, least: float) -> DataFrame:
    """(row, own_license, own_score): of the templates with the same qualifiers as a run, the one of the largest cosine to it;
    ties to what stands first, then to the first name."""
    weights, idf, rare = _weights(pieces.sparkSession)
    piece = ["row", "place", "length"]
    # A run without a template of its qualifiers isn't weighed.
    pieces = pieces.join(F.broadcast(weights.select("qualifiers").distinct()), "qualifiers", "left_semi")
    tf = pieces.select(*piece, "qualifiers", F.explode("run").alias("term")).groupBy(*piece, "qualifiers", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = tf.groupBy(*piece).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), ["term", "qualifiers"]).groupBy(*piece, "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    found = dots.join(norms, piece).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    # The text of the three-clause licence holds that of the two-clause one.
    three = F.coalesce(F.max(F.when(F.col("licence") == "BSD-3-Clause", F.col("score"))), F.lit(0.0))
    best = found.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "licence")).alias("m"), three.alias("three"))
    name = F.when((F.col("m.licence") == "BSD-2-Clause") & (F.col("three") >= -F.col("m.s")), F.lit("BSD-3-Clause")).otherwise(F.col("m.licence"))
    return best.select("row", name.alias("own_license"), (-F.col("m.s")).alias("own_score"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """One row per input row: keep, path, own_license, own_score, is_license_file, license, inherited_from.

    A file's own licence is the template nearest to a run of terms round a word that tells of licences, if near enough and with
    the same versions and qualifiers, so that one licence isn't taken for a variant of it; a licence file (by its base name)
    is scanned alike, and its title decides. license is the file's own, else that of the licence file in the nearest directory
    above it, whose path inherited_from gives; a directory with several takes the nearest to its template, then the first
    path. Rows without either have nulls.

    Null or empty texts have no headers; a null path is in no directory. Repeated rows are scanned once each; extra columns
    aren't read unless kept; an empty table gives an empty result. Only directories that hold a licence file are joined, so
    a directory with a third of all files costs one row on that side.
    """
    scratch, keep = Scratch(files.sparkSession, "licences"), keep or []
    renamed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    text, path = F.coalesce(F.col("_text"), F.lit("")), F.col("path")
    base = files.select(*renamed, F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("_text"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    is_file = F.coalesce(F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    listed = base.select("row", *[f"_k{i}" for i in range(len(keep))], "path", is_file.alias("is_license_file"), F.when(text.rlike(HEADER), text).alias("_text"))
    # Row numbers hold only as long as the scan is the same, so rows and the texts with headers are written once.
    listed = scratch.write(listed, "files")
    pieces = runs(listed.where("_text is not null").select("row", F.col("_text").alias("text")))
    own = scratch.write(best_licence(pieces, least), "own")
    rows = listed.drop("_text").join(own, "row", "left")
    held = own.join(listed.where("is_license_file and path is not null").select("row", "path"), "row")
    held = held.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "own_license", "own_score", F.col("path").alias("from"))
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "from", F.col("own_license").alias("licence"))).alias("m")).select("dir", "m.from", "m.licence")
    held = scratch.write(held, "dirs")
    # Each distinct directory looks up all directories above it once.
    dirs = rows.where("own_license is null and path is not null").select(F.regexp_replace("path", "/?[^/]*$", "").alias("at")).distinct()
    parts = F.split("at", "/")
    above = dirs.select("at", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("dir", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    above = above.where("depth = 0 or dir <> ''").dropDuplicates(["at", "dir"]).join(held, "dir")
    nearest = above.groupBy("at").agg(F.max(F.struct("depth", "from", "licence")).alias("m")).select("at", F.col("m.from").alias("_from"), F.col("m.licence").alias("_licence"))
    nearest = scratch.write(nearest, "nearest")
    rows = rows.withColumn("at", F.when(F.col("own_license").isNull(), F.regexp_replace("path", "/?[^/]*$", ""))).join(nearest, "at", "left")
    kept = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.select(*kept, "path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "_licence").alias("license"), F.when(F.col("own_license").isNull(), F.col("_from")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents table as a file tree: source, then language, then a file for each document; a document that is little
    more than a licence notice is its directory's licence file."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    name = F.when((words <= 40) & F.col("text").rlike(HEADER), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name).alias("path"), "text")


def document_sql(least: float = LEAST_COSINE) -> str:
    """The rows of scan() over document_paths() in DuckDB where a notice has a line of its own, as in the given table."""
    rows, rare = template_weights()
    own = {(name, i): qualifiers(terms_of(t)) for name, texts in TEMPLATES.items() for i, t in enumerate(texts)}
    values = ", ".join(f"('{name}', {i}, '{own[name, i]}', '{t}', {w!r}::DOUBLE)" for name, i, t, w in rows)
    n = sum(map(len, TEMPLATES.values()))
    words = " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in QUALIFIERS.items())
    return f"""
WITH tw(licence, template, ql, term, weight) AS (VALUES {values}),
idf AS (SELECT term, ln(1 + {n}.0 / count(*)) AS idf FROM tw GROUP BY term),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS dir,
  (len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) <= 40 AND regexp_matches(coalesce(text, ''), '{HEADER}')) AS is_license_file FROM documents),
f AS (SELECT *, dir || '/' || CASE WHEN is_license_file THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path FROM d),
p AS (SELECT r, string_split(t, chr(10)) AS l FROM f WHERE regexp_matches(t, '{HEADER}')),
q AS (SELECT r, unnest(generate_series(1, len(l))) AS piece, unnest(l) AS h FROM p),
e AS (SELECT r, piece, list_transform(regexp_extract_all(lower(h), '{TERM}'), lambda x: regexp_replace(x, '{VERSION}', '\\1')) AS terms FROM q WHERE regexp_matches(h, '{HEADER}')),
v AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(list_concat(CASE WHEN regexp_matches(array_to_string(terms, ' '), '{CLAUSE}') THEN ['{CLAUSED}'] ELSE [] END, list_transform(terms, lambda x: CASE {words} WHEN regexp_matches(x, '{VERSION}') THEN regexp_extract(x, '{VERSION}', 1) END)), lambda x: x IS NOT NULL))), ' ') AS ql FROM e),
t AS (SELECT r, piece, ql, unnest(terms) AS term FROM v),
tf AS (SELECT r, piece, ql, t.term, count(*) * any_value(coalesce(idf, {rare!r})) AS w FROM t LEFT JOIN idf ON t.term = idf.term GROUP BY r, piece, ql, t.term),
nm AS (SELECT r, piece, sqrt(sum(w * w)) AS norm FROM tf GROUP BY r, piece),
dt AS (SELECT tf.r, tf.piece, licence, template, sum(w * weight) AS dot FROM tf JOIN tw ON tf.term = tw.term AND tf.ql = tw.ql GROUP BY ALL),
sc AS (SELECT dt.r, dt.piece, licence, round(dot / norm, 6) AS score FROM dt JOIN nm ON dt.r = nm.r AND dt.piece = nm.piece WHERE round(dot / norm, 6) >= {least}),
own AS (SELECT r, CASE WHEN licence = 'BSD-2-Clause' AND (SELECT max(score) FROM sc o WHERE o.r = sc.r AND o.licence = 'BSD-3-Clause') >= score THEN 'BSD-3-Clause' ELSE licence END AS own_license, score AS own_score FROM sc QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, piece, licence) = 1),
held AS (SELECT f.dir, f.path AS src, own_license AS licence FROM own JOIN f ON own.r = f.r WHERE is_license_file QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY own_score DESC, f.path) = 1)
SELECT doc_id, path, own_license, own_score, is_license_file, coalesce(own_license, held.licence) AS license, CASE WHEN own_license IS NULL THEN held.src END AS inherited_from
FROM f LEFT JOIN own ON f.r = own.r LEFT JOIN held ON f.dir = held.dir
"""
