"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined with the k-gram positions of license templates. A hit at word p
of a text and word q of a template votes for the diagonal p - q; an occurrence of the template gathers its votes on one
diagonal, and on neighbouring ones where words were put in or left out. Neighbouring diagonals that lie together are
merged, and a span is verified by the share of the template's k-grams that it covers and by its length.

Exact phrases (``PHRASES``) give base labels; verified templates add labels of their own.

Defined results: a null text counts as empty; a text without a hit has no labels, score 0 and null positions; repeated
rows get equal results, a null doc_id stays null; texts are taken whole; an empty table gives no rows. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaloom.llm._common import cut, mapped, slices, table, texts_of
from quantaloom.llm._words import Words, grouped, mix, words_of

#: Phrases of the base and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and texts of public licenses, by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Licensed under the MIT License. See the LICENSE file for details."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced."),
]

#: k-grams, how far apart neighbouring diagonals may be, words between merged runs, and what verifies a span.
K, NEAR_DIAGONALS, GAP_WORDS, MIN_COVER, MAX_STRETCH = 3, 3, 12, 0.75, 1.6
#: Rows of the template table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def _rolling(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K words within a text, and the number of the first word."""
    h, n = words.hash, len(words.hash)
    if n < K:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(words.doc[: n - K + 1] == words.doc[K - 1 :])
    total = np.zeros(len(at), np.uint64)
    for i in range(K):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[at + i]
    return mix(total).view(np.int64), at


def template_positions(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(h, template, label, q, grams): each k-gram of each template. A template shorter than K words has none."""
    rows = []
    for number, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        hashes, at = _rolling(words_of([text]))
        rows += [(int(h), number, label, int(q), len(hashes)) for h, q in zip(hashes, at, strict=True)]
    return spark.createDataFrame(rows, "h long, template int, label string, q int, grams int")


def _base(words: Words) -> dict[str, np.ndarray]:
    """By phrase label: the numbers of words at which it begins."""
    found = {}
    for phrase, label in PHRASES.items():
        parts = words_of([phrase]).hash
        last = len(words.hash) - len(parts) + 1
        if last < 1:
            found[label] = np.empty(0, np.int64)
            continue
        same = words.doc[:last] == words.doc[len(parts) - 1 :]
        for i, part in enumerate(parts):
            same = same & (words.hash[i : last + i] == part)
        found[label] = np.flatnonzero(same)
    return found


def base_rows(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_words, n_base, first_word, last_word, base_labels for each row."""
    schema = docs.select("doc_id", "k1", "k2").schema
    for name, kind in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for _, texts in grouped(texts_of(batch)):
                words = words_of(texts)
                bounds = words.bounds()
                places: list[dict[str, list[int]]] = [{} for _ in texts]
                for label, at in _base(words).items():
                    for i in at.tolist():
                        places[words.doc[i]].setdefault(label, []).append(i - int(bounds[words.doc[i]]))
                for n, found in zip(np.diff(bounds).tolist(), places, strict=True):
                    every = [i for at in found.values() for i in at]
                    rows.append((n, len(every), min(every, default=None), max(every, default=None), ",".join(sorted(found))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return mapped(docs.select("doc_id", "k1", "k2", "text"), run, schema)


def rolling_rows(docs: DataFrame) -> DataFrame:
    """k1, k2, p, h: all rolling k-gram hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for first, texts in grouped(texts_of(batch)):
                words = words_of(texts)
                hashes, at = _rolling(words)
                per_doc = np.bincount(words.doc[at], minlength=len(texts))
                ends = pa.array(np.r_[0, np.cumsum(per_doc)].astype(np.int32))
                keys = [batch.column(c).slice(first, len(texts)) for c in ("k1", "k2")]
                yield pa.record_batch([*keys, pa.ListArray.from_arrays(ends, pa.array(hashes))], names=["k1", "k2", "hashes"])

    rolled = mapped(docs.select("k1", "k2", "text"), run, "k1 long, k2 long, hashes array<long>")
    return rolled.select("k1", "k2", F.posexplode("hashes").alias("p", "h"))


def template_spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """k1, k2, template, label, first, last, cover: merged diagonals of each text and template, unverified."""
    positions = F.broadcast(templates) if templates.count() <= BROADCAST_ROWS else templates
    hits = rolling_rows(docs).join(positions, "h")
    votes = hits.groupBy("k1", "k2", "template", "label", "grams", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("q").alias("qs")
    )
    of_text = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(of_text) > NEAR_DIAGONALS) | (F.col("low") - F.max("high").over(of_text.rowsBetween(Window.unboundedPreceding, -1)) > GAP_WORDS)
    marked = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = marked.withColumn("span", F.sum("new").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("k1", "k2", "template", "label", "grams", "span").agg(
        F.min("low").alias("first"), (F.max("high") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("grams_met")
    )
    return spans.withColumn("cover", F.col("grams_met") / F.col("grams"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for each row."""
    if templates is None:
        templates = template_positions(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"))
    length = F.col("last") - F.col("first") + 1
    verified = (F.col("cover") >= MIN_COVER) & (length <= MAX_STRETCH * (F.col("grams") + K - 1))
    found = template_spans(keyed, templates).groupBy("k1", "k2").agg(
        # A span that is stretched beyond what verifies counts by as much less.
        F.max(F.col("cover") * F.least(F.lit(1.0), MAX_STRETCH * (F.col("grams") + K - 1) / length)).alias("best"),
        F.array_sort(F.collect_set(F.when(verified, F.col("label")))).alias("own"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("first", "last", "label")))).alias("spans"),
    )
    out = base_rows(keyed).join(cut(found), ["k1", "k2"], "left")
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", F.array().cast("array<string>")))), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string>>")).alias("spans"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE: dict[str, str] = {}
