"""License scan: MinHash bands over overlapping windows, then exact containment. DataFrame functions only.

A window is `window` adjacent shingles, one at every shingle; a band's key is the smallest
of the window's hashes under that band's permutation. Templates with fewer shingles have
windows of their own size, of which documents make keys too. So wherever a document holds
adjacent shingles enough to fill one window of a template, the two windows are the same
set and have the same key in every band: such a template is retrieved with certainty,
at either end of a text as in the middle. Only where no two of a template's shingles stand
side by side is retrieval a matter of chance: such a shingle is the smallest of one of its two
windows in the document, and of one of those in the template, with probability 4/9 a band,
so with 8 bands it retrieves its template with probability 1 - (5/9)^8 = 0.99, two of them
with 0.9999.

Few templates travel as literals, and a scan needs no shuffle; more than LITERAL_WORDS are
joined as tables.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, stage, text_of

#: Short notices of public licences, each as it is commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

WORD_SPLIT = r"[^\p{L}\p{N}]+"
SHINGLE, WINDOW, BANDS = 5, 2, 8
#: Templates of so many words in all are put into the plan; of more, or not in ASCII, tables are joined.
LITERAL_WORDS = 10_000


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), WORD_SPLIT, -1), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """64-bit hashes of the shingles in order; none for fewer words than a shingle has."""
    n = F.size(words) - size + 1
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    ).otherwise(F.array().cast("array<bigint>"))


def _keys(shingles: Column, size: int, bands: int) -> Column:
    """For each band and window of `size` shingles the smallest permuted hash; of fewer shingles one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(shingles) - size + 1, F.lit(1)))

    def band(b: int) -> Column:
        return let(
            F.transform(shingles, lambda x: F.xxhash64(F.lit(b), x)),
            lambda permuted: F.transform(starts, lambda i: F.array_min(F.slice(permuted, i, size))) if size > 1 else permuted,
        )

    return F.array_distinct(F.concat(*[band(b) for b in range(bands if size > 1 else 1)]))


def _window_keys(shingles: Column, sizes: list[int], bands: int) -> Column:
    """The keys of the windows of each of these sizes."""
    return F.array_distinct(F.concat(*[_keys(shingles, size, bands) for size in sizes]))


def _template_keys(shingles: Column, window: int, bands: int) -> Column:
    """The keys of the largest windows that the template fills."""
    keys = _keys(shingles, window, bands)
    for size in range(window - 1, 0, -1):
        keys = F.when(F.size(shingles) == size, _keys(shingles, size, bands)).otherwise(keys)
    return keys


def _python_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


def hitting_words(templates: dict[str, str], shingle: int, min_containment: float) -> list[str]:
    """Words without any of which a document can't hold min_containment of a template's shingles.

    For each template the longest words first, until the shingles without any of them
    are fewer than min_containment.
    """
    found: set[str] = set()
    for words in map(_python_words, templates.values()):
        shingles = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
        left = {s for s in shingles if not found & set(s)}
        while left and len(left) >= min_containment * len(shingles):
            found.add(max({w for s in left for w in s}, key=lambda w: (len(w), w)))
            left = {s for s in left if not found & set(s)}
    return sorted(found)


def _containment(rows: DataFrame, min_containment: float) -> DataFrame:
    return rows.withColumn("containment", F.col("n_shared") / F.col("n_template")).filter(F.col("containment") >= min_containment)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | DataFrame | None = None,
    min_containment: float = 0.8,
    shingle: int = SHINGLE,
    window: int = WINDOW,
    bands: int = BANDS,
    literal_words: int = LITERAL_WORDS,
) -> DataFrame:
    """Licences whose template shingles a document holds to min_containment or more.

    docs: doc_id, text; other columns are ignored. templates: id to text, or a table
    license, text (of an id that is repeated, the smallest text counts); those of fewer words
    than a shingle are never found. Returns a row for each row of docs and template found: doc_id,
    license, n_shared, n_template (distinct shingles), containment. Words are runs of
    letters and digits, A-Z lower-cased. Null, empty and shorter texts have no shingles and
    give no row; repeated rows give theirs each; an empty table gives an empty one.
    """
    if isinstance(templates, DataFrame):
        return _scan_by_join(docs, templates, min_containment, shingle, window, bands)
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    if sum(len(_python_words(t)) for t in templates.values()) > literal_words or not all(t.isascii() for t in templates.values()):
        return _scan_by_join(docs, table, min_containment, shingle, window, bands)
    s = _shingles(F.col("words"), shingle)
    known = (
        table.select("license", _words(F.col("text")).alias("words"))
        .select("license", F.array_distinct(s).alias("shingles"), _template_keys(s, window, bands).alias("keys"), F.size(s).alias("n"))
        .filter("n > 0")
        .collect()
    )
    sizes = sorted({min(window, r.n) for r in known}) or [1]
    literal = F.from_json(
        F.lit(json.dumps([{"license": r.license, "shingles": r.shingles, "keys": r["keys"]} for r in known])), "array<struct<license:string,shingles:array<bigint>,keys:array<bigint>>>"
    )
    all_keys = F.from_json(F.lit(json.dumps(sorted({k for r in known for k in r["keys"]}))), "array<bigint>")
    any_word = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(hitting_words(templates, shingle, min_containment)) + r")(?![\p{L}\p{N}])"

    def checked(shingles: Column, hits: Column) -> Column:
        """The exact step: containment of each retrieved template."""
        return F.transform(
            F.filter(literal, lambda t: F.arrays_overlap(t["keys"], hits)),
            lambda t: F.struct(
                t["license"].alias("license"),
                F.size(F.array_intersect(shingles, t["shingles"])).cast("long").alias("n_shared"),
                F.size(t["shingles"]).cast("long").alias("n_template"),
            ),
        )

    found = let(
        _words(F.col("text")),
        lambda words: let(
            _shingles(words, shingle),
            lambda s: let(F.array_intersect(_window_keys(s, sizes, bands), all_keys), lambda hits: checked(s, hits)),
        ),
    )
    texts = docs.select("doc_id", text_of().alias("text")).filter(F.col("text").rlike(any_word))
    rows = texts.select("doc_id", F.explode(found).alias("found")).select("doc_id", "found.*")
    return _containment(rows, min_containment)


def _scan_by_join(docs: DataFrame, templates: DataFrame, min_containment: float, shingle: int, window: int, bands: int) -> DataFrame:
    """The scan with the templates' keys and shingles as tables; equal texts are compared once.

    Documents' keys are joined with the templates' (a shuffle of the keys unless Spark finds
    the templates small enough to broadcast, or leaves out keys by a Bloom filter).
    """
    s = _shingles(F.col("words"), shingle)
    known = templates.filter("license IS NOT NULL").groupBy("license").agg(F.min("text").alias("text"))
    known = known.select("license", _words(text_of()).alias("words")).select("license", s.alias("s")).filter(F.size("s") > 0)
    known = stage(known.select("license", F.array_distinct("s").alias("of_template"), _template_keys(F.col("s"), window, bands).alias("keys")), "templates")
    text_key = [F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), F.col("text")).alias("text_b")]
    rows = docs.select("doc_id", text_of().alias("text"))
    sized = rows.select(*text_key, _words(F.col("text")).alias("words")).select("text_a", "text_b", s.alias("s")).filter(F.size("s") > 0)
    keys = sized.select("text_a", "text_b", F.explode(_window_keys(F.col("s"), list(range(1, window + 1)), bands)).alias("key")).distinct()
    pairs = keys.join(known.select("license", F.explode("keys").alias("key")), "key").select("text_a", "text_b", "license").distinct()
    pairs = stage(pairs, "license-pairs")
    of_text = sized.select("text_a", "text_b", F.array_distinct("s").alias("of_text"))
    of_text = of_text.join(pairs.select("text_a", "text_b").distinct(), ["text_a", "text_b"], "left_semi").dropDuplicates(["text_a", "text_b"])
    both = pairs.join(of_text, ["text_a", "text_b"]).join(known.select("license", "of_template"), "license")
    counted = both.select(
        "text_a", "text_b", "license",
        F.size(F.array_intersect("of_text", "of_template")).cast("long").alias("n_shared"),
        F.size("of_template").cast("long").alias("n_template"),
    )
    found = stage(_containment(counted, min_containment), "licenses-found")
    return rows.select("doc_id", *text_key).join(found, ["text_a", "text_b"]).select("doc_id", "license", "n_shared", "n_template", "containment")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _op3_sql() -> str:
    rows = {
        (name, " ".join(w[i : i + SHINGLE]))
        for name, w in ((n, _python_words(t)) for n, t in TEMPLATES.items())
        for i in range(len(w) - SHINGLE + 1)
    }
    values = ", ".join(f"('{n}', '{s}')" for n, s in sorted(rows))
    return rf"""
WITH template(license, shingle) AS (VALUES {values}),
sizes AS (SELECT license, count(*) AS n_template FROM template GROUP BY license),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SPLIT}'),
           lambda w: w <> '') AS ws FROM documents
), shingles AS (
  SELECT doc_id, array_to_string(ws[i : i + {SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM words)
)
SELECT s.doc_id, t.license, count(DISTINCT t.shingle) AS n_shared, z.n_template,
       count(DISTINCT t.shingle) / z.n_template AS containment
FROM shingles s JOIN template t USING (shingle) JOIN sizes z ON z.license = t.license
GROUP BY s.doc_id, t.license, z.n_template
HAVING count(DISTINCT t.shingle) / z.n_template >= 0.8
"""


OP3_SQL = _op3_sql()
