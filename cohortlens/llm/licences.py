"""Licence scans: TF-IDF cosine of licence statements to templates, then inheritance from the nearest directory.

A file's candidates are its lines with a licence cue and, if there is such a line, the runs of neighbouring lines (all
comments, or none) and their paragraphs that hold one (a header), and its whole text (a licence file).
Terms are weighted by their number and by the inverse document frequency over all files; terms that no template has
weigh as the most common ones. A candidate states the template with the highest cosine, from a threshold on. A file
without a statement inherits that of the nearest directory above it that holds a licence file: the first file directly
in a directory, by id, that states a licence.

All steps are DataFrame functions: sparse vectors are rows (file, candidate, term).
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTICE = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published "
          "by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
REST = (" This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU "
        "{1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>.")
GNU = [("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"),
       ("LGPL-3.0", "library", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3")]
#: Whole licences, one file each.
TEXTS = resources.files(__package__) / "licence_texts"  # also within a zipped package


def whole_texts(folder=TEXTS) -> list[tuple[str, str]]:
    """(name, text) of every licence text in ``folder``; none at all is an error, for scans would silently miss them."""
    found = sorted((p.name, p.read_text(encoding="utf-8")) for p in folder.iterdir() if p.name.endswith(".txt")) if folder.is_dir() else []
    if not found:
        raise FileNotFoundError(f"no licence texts in {folder}")
    return [(name.removesuffix(".txt"), text) for name, text in found]


# Short forms in which public licences are stated, headers and full texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    *[(k, NOTICE.format(*x)) for k, *x in GNU],
    *[(k, NOTICE.format(*x) + REST.format(*x)) for k, *x in GNU],
    *whole_texts(),
]
CUE = r"(?i)licen[sc]e|all rights reserved|public domain|permission is hereby granted|permission to use|redistribut|spdx"
#: The start of a comment line, runs of lines that have one or have none, and what parts the paragraphs of a run.
MARK = r"[ \t]*+(?:#|//|--|;|%|/?\*)"
RUN = rf"(?m)(?:^{MARK}[^\n]*+(?:\n|\z)){{2,}}+|(?:^(?!{MARK})[ \t]*+[^\s][^\n]*+(?:\n|\z)){{2,}}+"
GAP = r"(?m)^[ \t]*+[#/*;%-]++[ \t\r]*+$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
MIN_COSINE = 0.7


def terms_of(text) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def template_terms(spark) -> DataFrame:
    """(template, licence, term, tf): a few hundred rows."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, licence string, body string")
    return (rows.select("template", "licence", F.explode(terms_of("body")).alias("term"))
            .groupBy("template", "licence", "term").agg(F.count("*").cast("double").alias("tf")))


def stated_licences(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(file_id, licence, cosine) of the files that state one; the highest cosine, ties by name."""
    spark = files.sparkSession
    templates = template_terms(spark)
    known = sorted({t for _, body in TEMPLATES for t in re.findall(TERM, body.lower())})
    present = F.array_intersect(terms_of(F.col("text")), F.array(*[F.lit(t) for t in known]))
    total = files.where("text is not null").agg(F.count("*").alias("n")).first()["n"]
    df = files.select(F.explode(present).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + F.lit(total)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    vocabulary = templates.select("term").distinct().join(df, "term", "left").select("term", idf.alias("idf"))
    weighted = templates.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # As many rows as the templates have terms.
    unit = weighted.join(F.broadcast(norms), "template").select("template", "licence", "term", "idf", (F.col("w") / F.col("norm")).alias("tw"))

    cued = lambda x: x.rlike(CUE)
    lines = F.filter(F.split("text", "\n"), cued)
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)), cued)
    paragraphs = F.filter(F.flatten(F.transform(runs, lambda x: F.split(x, GAP))), cued)
    parts = (files.where(F.col("text").rlike(CUE))
             .select("file_id", F.posexplode(F.array_distinct(F.concat(lines, runs, paragraphs, F.array("text")))).alias("part", "body")))
    tf = (parts.select("file_id", "part", F.explode(terms_of("body")).alias("term"))
          .groupBy("file_id", "part", "term").agg(F.count("*").cast("double").alias("tf")))
    scored = tf.join(F.broadcast(vocabulary), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    length = scored.groupBy("file_id", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = (scored.where("idf is not null").select("file_id", "part", "term", "w")
            .join(F.broadcast(unit.select("template", "licence", "term", "tw")), "term")
            .groupBy("file_id", "part", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot")))
    best = (dots.join(length, ["file_id", "part"]).select("file_id", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("cosine"))
            .where(F.col("cosine") >= min_cosine)
            .groupBy("file_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")))
    return best.select("file_id", "b.licence", (-F.col("b.c")).alias("cosine"))


def scan_licences(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """file_id, path, stated, cosine, licence, inherited_from of every row of ``files(file_id, path, text)``.

    ``stated`` is the file's own licence and ``licence`` that or the inherited one; both are null if there is none, and
    ``inherited_from`` is the directory it came from. A null text states nothing. A null path is the root's. A null id
    cannot be a licence file and states nothing. Rows that share an id share a statement. Equal cosines go to the first
    name. Other columns are ignored.
    """
    files = files.select("file_id", F.coalesce("path", F.lit("/")).alias("path"), "text")
    stated = stated_licences(files.where("file_id is not null").select("file_id", "text"), min_cosine)
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))
    placed = (files.select("file_id", "path", folder.alias("folder")).join(stated, "file_id", "left"))
    own = (placed.where("licence is not null").groupBy("folder").agg(F.min_by("licence", "file_id").alias("theirs"))
           .withColumnRenamed("folder", "above"))
    # Inheritance is settled for each folder, not for each file.
    steps = F.split(F.regexp_replace("folder", "^/", ""), "/")
    above = F.when(F.col("folder") == "/", F.array(F.lit("/"))).otherwise(F.concat(
        F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))))
    settled = (placed.select("folder").distinct().select("folder", F.explode(above).alias("above")).join(own, "above")
               .groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "theirs")).alias("near"))
               .select(F.col("folder"), F.col("near.above").alias("above"), F.col("near.theirs").alias("theirs")))
    out = placed.join(settled, "folder", "left")
    return out.select("file_id", "path", F.col("licence").alias("stated"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
                      F.coalesce("licence", "theirs").alias("licence"), F.when(F.col("licence").isNull(), F.col("above")).alias("inherited_from"))


def document_paths(docs: DataFrame) -> DataFrame:
    """(file_id, path, text): documents have no paths, so that source and id stand in for a tree of three levels.

    Of a source's documents, those with an id divisible by 200 lie in the source's folder, others divisible by 50 in a
    folder for 10,000 ids, and the rest in one for 1,000 ids below it.
    """
    i = F.col("doc_id")
    path = (F.when(i % 200 == 0, F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), i))
            .when(i % 50 == 0, F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.expr("doc_id div 10000"), i))
            .otherwise(F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.expr("doc_id div 10000"), F.expr("doc_id div 1000"), i)))
    return docs.select(i.alias("file_id"), path.alias("path"), "text")


def oracle() -> str:
    """The same for documents, in DuckDB's SQL."""
    quoted = ",".join(f"({n}, '{k}', '{t.replace(chr(39), chr(39) * 2)}')" for n, (k, t) in enumerate(TEMPLATES))
    cue, term = CUE, TERM
    return f"""
WITH templates(template, licence, body) AS (VALUES {quoted}),
tt AS (SELECT template, licence, term, count(*)::DOUBLE AS tf
       FROM (SELECT template, licence, unnest(regexp_extract_all(lower(body), '{term}')) AS term FROM templates) GROUP BY ALL),
files AS (SELECT doc_id AS file_id, text, CASE
            WHEN doc_id % 200 = 0 THEN '/' || coalesce(source, 'none') || '/' || doc_id
            WHEN doc_id % 50 = 0 THEN '/' || coalesce(source, 'none') || '/' || (doc_id // 10000) || '/' || doc_id
            ELSE '/' || coalesce(source, 'none') || '/' || (doc_id // 10000) || '/' || (doc_id // 1000) || '/' || doc_id END AS path
          FROM documents),
seen AS (SELECT DISTINCT file_id, term FROM (SELECT file_id, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM files)),
df AS (SELECT term, count(*) AS df FROM seen SEMI JOIN tt USING (term) GROUP BY term),
vocabulary AS (SELECT term, ln((1.0 + (SELECT count(text) FROM files)) / (1.0 + coalesce(df, 0))) + 1.0 AS idf
               FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
tw AS (SELECT template, licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw FROM tt JOIN vocabulary USING (term)),
cued AS (SELECT file_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{cue}')) AS hits
         FROM files WHERE regexp_matches(text, '{cue}')),
parts AS (SELECT file_id, unnest(range(len(hits) + 1)) AS part, unnest(list_append(hits, text)) AS body FROM cued),
tf AS (SELECT file_id, part, term, count(*)::DOUBLE AS tf
       FROM (SELECT file_id, part, unnest(regexp_extract_all(lower(body), '{term}')) AS term FROM parts) GROUP BY ALL),
w AS (SELECT file_id, part, term, tf * coalesce(idf, 1.0) AS w, idf FROM tf LEFT JOIN vocabulary USING (term)),
lengths AS (SELECT file_id, part, sqrt(sum(w * w)) AS length FROM w GROUP BY ALL),
cosines AS (SELECT file_id, licence, round(sum(w * tw) / any_value(length), 6) AS cosine
            FROM w JOIN tw USING (term) JOIN lengths USING (file_id, part) GROUP BY file_id, part, template, licence),
stated AS (SELECT file_id, licence, cosine FROM cosines WHERE cosine >= {MIN_COSINE}
           QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY cosine DESC, licence) = 1),
placed AS (SELECT file_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, licence, cosine FROM files LEFT JOIN stated USING (file_id)),
own AS (SELECT folder AS above, arg_min(licence, file_id) AS theirs FROM placed WHERE licence IS NOT NULL GROUP BY folder),
settled AS (SELECT p.folder, arg_max(above, length(above)) AS above, arg_max(theirs, length(above)) AS theirs
            FROM (SELECT DISTINCT folder FROM placed) p JOIN own ON p.folder = above OR starts_with(p.folder, above || '/') GROUP BY p.folder)
SELECT file_id AS doc_id, path, licence AS stated, coalesce(cosine, 0.0) AS cosine, coalesce(licence, theirs) AS licence,
       CASE WHEN licence IS NULL THEN above END AS inherited_from
FROM placed LEFT JOIN settled USING (folder)
"""
