"""License texts and notices in documents, by voting on diagonals.

The hashes of all rolling ``GRAM``-word windows of a document are joined with the positions at which license templates
have the same window. A hit at document word ``p`` and template word ``q`` votes for the diagonal ``p - q``: an
unchanged copy puts all its votes on one diagonal, an inserted or left-out word moves the rest to one nearby. Votes are
counted per diagonal, neighbouring diagonals of one template are merged into a candidate span, and candidates with enough
votes are verified word by word in the text.

Equal texts are one text here, known by digest: their votes meet before the shuffle. The table of template windows is
as large as the templates, a parameter; the planner sees its size and chooses the join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripspark.llm.shingles import word_print
from tripspark.session import materialize

GRAM = 4
#: Share of a template's windows that must vote before a span is read, and of its words that must stand in the span.
LEAST_VOTES, LEAST_SHARE = 0.25, 0.75
#: Neighbouring diagonals are at most this far apart, and no farther than an eighth of the template's words.
MOST_SHIFT = 10
_ARRAY_BYTES = 8 << 20

# The phrases of the base rule and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices and conditions, with the label each stands for.
TEMPLATES = {
    "mit-line": ("mit", "Released under the MIT License."),
    "apache-line": ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "gpl-line": ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "cc-by-nc-line": ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-line": ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-line": (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "mit-grant": (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "isc-grant": (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd-conditions": (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    "bsd-endorsement": (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "apache-notice": (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    "gpl-3-notice": (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "gpl-2-notice": (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    "mpl-notice": (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "unlicense": (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
}

# A-Z become a-z; what else is neither a digit, a letter nor beyond ASCII becomes a space.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

Templates = Mapping[str, tuple[str, str]]


def license_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and anything beyond ASCII; none for null."""
    return [] if text is None else text.encode().translate(_FOLDED).split()


def _windows(words: list[bytes]) -> np.ndarray:
    """Rolling hash of every window of GRAM words, as signed 64-bit numbers."""
    if len(words) < GRAM:
        return np.empty(0, np.int64)
    prints = np.fromiter(map(word_print, words), np.uint64, len(words))
    last = len(words) - GRAM
    mixed = np.zeros(last + 1, np.uint64)
    for at in range(GRAM):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + prints[at : last + 1 + at]
    return mixed.view(np.int64)


def template_windows(spark: SparkSession, templates: Templates) -> DataFrame:
    """Rows (gram, template, place, n_grams, shift) of all windows of the templates."""
    rows = []
    for name, (_, text) in templates.items():
        words = license_words(text)
        if len(words) < GRAM:
            raise ValueError(f"template {name} has fewer than {GRAM} words")
        shift = max(1, min(MOST_SHIFT, len(words) // 8))
        grams = _windows(words).tolist()
        rows += [(gram, name, place, len(grams), shift) for place, gram in enumerate(grams)]
    windows = spark.createDataFrame(rows, "gram long, template string, place int, n_grams int, shift int")
    # Written, so that the planner knows how small it is before it deals out the documents' windows.
    return materialize(windows, "license-windows")


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode()).digest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(grams) for _, grams in held)]).astype(np.int32)
        grams = pa.array(np.concatenate([grams for _, grams in held]), pa.int64())
        digests = pa.array([digest for digest, _ in held], pa.binary())
        return pa.RecordBatch.from_arrays([digests, pa.ListArray.from_arrays(pa.array(ends), grams)], ["digest", "grams"])

    for batch in batches:
        held, size = [], 0
        for text in batch.column("text"):
            text = text.as_py()
            grams = _windows(license_words(text))
            if len(grams):
                held.append((_digest(text), grams))
                size += grams.nbytes
            if size > _ARRAY_BYTES:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (digest, template, diagonals) of merged neighbouring diagonals with enough votes, per distinct text."""
    hashed = docs.where("text is not null").select("text").mapInArrow(_hashed, "digest binary, grams array<long>")
    rolled = hashed.select("digest", F.posexplode("grams").alias("at", "gram"))
    hits = rolled.join(windows, "gram")
    # Copies of a text cast the same votes; a set counts them once.
    votes = hits.groupBy("digest", "template", "n_grams", "shift", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )
    along = Window.partitionBy("digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("shift")
    runs = votes.withColumn("new", F.coalesce(apart.cast("int"), F.lit(0)))
    runs = runs.withColumn("run", F.sum("new").over(along))
    merged = runs.groupBy("digest", "template", "run", "n_grams").agg(
        F.sort_array(F.collect_list("diagonal")).alias("diagonals"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"),
    )
    return merged.where(F.col("votes") >= LEAST_VOTES * F.col("n_grams")).select("digest", "template", "diagonals")


def _verified(templates: Templates):
    words_of = {name: license_words(text) for name, (_, text) in templates.items()}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            columns = (batch.column(c) for c in ("digest", "text", "spans"))
            for digest, text, spans in zip(*columns, strict=True):
                words = license_words(text.as_py())
                for span in spans.as_py():
                    wanted = words_of[span["template"]]
                    same = [
                        (q, q + d)
                        for d in span["diagonals"]
                        for q in range(max(0, -d), min(len(wanted), len(words) - d))
                        if words[q + d] == wanted[q]
                    ]
                    share = len({q for q, _ in same}) / len(wanted)
                    if share >= LEAST_SHARE:
                        places = [p for _, p in same]
                        found.append((digest.as_py(), span["template"], min(places), max(places), share))
            if found:
                values = list(zip(*found, strict=True))
                kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["digest", "template", "first", "last", "share"])

    return verify


def license_spans(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """Verified spans of each distinct text of ``docs``: digest (MD5 of the text), template, first and last word, share.

    ``share`` is the part of the template's words that stand on the span's diagonals, ``LEAST_SHARE`` or more.
    """
    found = candidates(docs, template_windows(docs.sparkSession, templates))
    spans = found.groupBy("digest").agg(F.collect_list(F.struct("template", "diagonals")).alias("spans"))
    spans = materialize(spans, "license-candidates")
    texts = docs.where("text is not null").select(F.unhex(F.md5("text")).alias("digest"), "text")
    verified = texts.join(spans, "digest").mapInArrow(
        _verified(templates), "digest binary, template string, first long, last long, share double"
    )
    return verified.distinct()


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sought = [(re.compile(b"(?= " + phrase.encode() + b" )"), label) for phrase, label in PHRASES.items()]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            words = license_words(text)
            line = b" " + b" ".join(words) + b" "
            n, first, last, labels = 0, None, None, set()
            for phrase, label in sought:
                at = place = 0
                for hit in phrase.finditer(line):
                    # The word that starts after this space has as many words before it as there are spaces.
                    place += line.count(b" ", at, hit.start())
                    at = hit.start()
                    n += 1
                    labels.add(label)
                    first = place if first is None else min(first, place)
                    last = place if last is None else max(last, place)
            rows.append((_digest(text), len(words), n, first, last, sorted(labels)))
        values = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        names = ["digest", "n_words", "n_base", "first_word", "last_word", "base"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def scan(docs: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``base_labels`` are those of the phrases that stand in the text, ``labels`` also those of verified spans, distinct,
    sorted and joined by commas (empty without any). ``score`` is 1 where a phrase stands, else the largest share of a
    template's words in a verified span, else 0. A null text is empty. Repeated rows and null ids come back as they are,
    very long texts are taken whole, other columns are ignored, no rows give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(
        _base,
        f"doc_id {kind}, digest binary, n_words long, n_base long, first_word long, last_word long, base array<string>",
    )
    label_of = F.create_map(*[F.lit(x) for name, (label, _) in templates.items() for x in (name, label)])
    spans = license_spans(docs, templates).withColumn("label", label_of[F.col("template")])
    found = spans.groupBy("digest").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = rows.join(found, "digest", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
