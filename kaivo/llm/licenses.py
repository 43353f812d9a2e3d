"""License scans by a positional rare-token index, with DataFrame functions only.

Templates are short notices. Document frequencies of all their words are counted over the whole corpus; of each template the
RARE words of highest IDF are indexed with their positions. A file's words are looked up there, hits are grouped by template
and by (position in file - position in template), and the largest IDF share that stands at one offset is the template's score.
A template counts from MATCH on if all its key phrases stand in the file, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaivo.llm.scratch import written

RARE, MATCH = 8, 0.7

# Phrases that give a label by themselves.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Label, what a tag names.
SPDX = (
    ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("epl", "epl"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"),
    ("cc-by-nd", "cc by nd"), ("cc0", "cc0"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("bsl", "bsl"), ("artistic", "artistic"), ("wtfpl", "wtfpl"), ("ofl", "ofl"),
)
# Label, notice, key phrases.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance with the license")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("this permission notice shall be included in all copies or substantial portions of the software",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice",)),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software", ("this permission notice appear in all copies",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such", ("the origin of this software must not be misrepresented",)),
    ("bsl", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed under the license is distributed on an as is basis",)),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl was not distributed with this file",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("distributed in the hope that it will be useful", "gnu general public license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("artistic", "this program is free software you can redistribute it and or modify it under the terms of the artistic license", ("artistic license",)),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    *((label, f"spdx license identifier {tag}", (f"spdx license identifier {tag}",)) for label, tag in SPDX),
)
PHRASES = tuple(dict.fromkeys([p for _, p in BASE] + [p for *_, ps in TEMPLATES for p in ps]))
VOCABULARY = tuple(dict.fromkeys(w for x in [*(t for _, t, _ in TEMPLATES), *PHRASES] for w in x.split()))
#: One of these words stands in every phrase, and so in every file that can get a label.
ANCHORS = ("cc", "license", "reserved", "granted", "redistribution", "redistributions", "unencumbered", "waived", "creative", "permission", "misrepresented", "mpl", "hope")
assert all(not set(p.split()).isdisjoint(ANCHORS) for p in PHRASES)


def words(text: Column) -> Column:
    """The words of a text, with an empty string before them and after them if it begins or ends with none."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its license labels, from the whole text.

    doc_id; n_words; n_base: places of base phrases; first_word, last_word: smallest and largest start of those, else null;
    base_labels; labels: with the templates' (each distinct, sorted, comma-joined, empty if none); score: 1 with a base label, else the
    best score of a template that counts, else 0. A null text is empty. Repeated rows give repeated rows; an empty table
    none; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w = F.col("w")
    first = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
    last = F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    flagged = F.arrays_overlap(w, _strings(ANCHORS))
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("w")).select(
        "doc_id", "th", (F.size(w) - first - last).cast("long").alias("n_words"), F.array_intersect(_strings(VOCABULARY), w).alias("own"), F.when(flagged, F.slice(w, first + 1, F.size(w) - first)).alias("w")
    )
    table = written(table, "license-words")
    # as many rows as VOCABULARY has words
    df = {r["word"]: r["n"] for r in table.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    n_docs = table.count()
    idf = {x: float(_log(n_docs, df.get(x, 0))) for x in VOCABULARY}

    entries = []  # (word, kind, id, position, weight)
    for k, p in enumerate(PHRASES):
        entries += [(x, "phrase", k, i, 1.0 / len(p.split())) for i, x in enumerate(p.split())]
    for k, (_, t, _) in enumerate(TEMPLATES):
        rare = sorted(set(t.split()), key=lambda x: (-idf[x], x))[:RARE]
        spots = [(i, x) for i, x in enumerate(t.split()) if x in rare]
        whole = sum(idf[x] for _, x in spots)
        entries += [(x, "template", k, i, idf[x] / whole) for i, x in spots]
    index = F.broadcast(spark.createDataFrame(entries, "word string, kind string, id int, spot int, weight double"))  # the templates' words
    phrase_label = F.create_map(*(F.lit(x) for k, p in enumerate(PHRASES) for x in (k, dict((b, a) for a, b in BASE).get(p, ""))))
    labels = F.create_map(*(F.lit(x) for k, (label, *_) in enumerate(TEMPLATES) for x in (k, label)))
    keys = F.create_map(*(x for k, (*_, ps) in enumerate(TEMPLATES) for x in (F.lit(k), F.array(*(F.lit(PHRASES.index(p)) for p in ps)))))

    files = table.where("w is not null").select("doc_id", "th", "w").dropDuplicates(["doc_id", "th"])
    hits = files.select("doc_id", "th", F.posexplode("w").alias("at", "word")).join(index, "word")
    aligned = hits.groupBy("doc_id", "th", "kind", "id", (F.col("at") - F.col("spot")).alias("start")).agg(F.sum("weight").alias("score"))
    aligned = aligned.where(F.col("score") >= F.when(F.col("kind") == "phrase", 1 - 1e-9).otherwise(MATCH - 1e-9))
    per_file = aligned.groupBy("doc_id", "th").agg(
        F.collect_set(F.when(F.col("kind") == "phrase", F.col("id"))).alias("phrases"),
        F.count(F.when((F.col("kind") == "phrase") & (phrase_label[F.col("id")] != ""), 1)).alias("n_base"),
        F.min(F.when((F.col("kind") == "phrase") & (phrase_label[F.col("id")] != ""), F.col("start"))).alias("first_word"),
        F.max(F.when((F.col("kind") == "phrase") & (phrase_label[F.col("id")] != ""), F.col("start"))).alias("last_word"),
    )
    # templates and scores again, by template: those whose key phrases all stand in the file
    best = aligned.where("kind = 'template'").groupBy("doc_id", "th", "id").agg(F.max("score").alias("score"))
    on = ["doc_id", "th"]
    verified = _null_safe(best, per_file.select("doc_id", "th", "phrases"), on).where(F.size(F.array_except(keys[F.col("id")], F.col("phrases"))) == 0)
    verified = verified.groupBy("doc_id", "th").agg(F.collect_set(labels[F.col("id")]).alias("found"), F.max("score").alias("best"))
    result = _null_safe(_null_safe(table.select("doc_id", "th", "n_words"), per_file, on, "left"), verified, on, "left")
    base = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("phrases", F.array().cast("array<int>")), lambda p: phrase_label[p]), lambda x: x != "")))
    both = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))))
    return result.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score"),
    )


def _log(n: int, df: int) -> float:
    from math import log

    return log((n + 1) / (df + 0.5))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which a null key meets a null key."""
    r = right.select(*(F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns))
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(r[f"r_{c}"])
    return left.join(r, match, how).drop(*(f"r_{c}" for c in on))
