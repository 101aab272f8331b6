"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Words are lower-cased runs of ASCII letters and digits and anything beyond ASCII. A template is a vector of its words'
counts times their inverse document frequencies, ln((1 + N) / (1 + df)) + 1, with df and N counted over all documents;
words in no template have df 0. Every line of a text (a header or notice) and every text as a whole (a licence file)
is compared with every template. A document's own licence is that of the greatest cosine of CLOSE or more; of equal
ones the first template's.

A licence file is a document with a licence of its own whose matching lines hold at least SHARE of its words, or whose
whole text matches. It covers its directory and all below: a document without a licence takes that of the nearest
ancestor directory (its own first) that holds a licence file; of several files there the one of greatest cosine, then
smallest id. Directories meet their ancestors by joins on the distinct directories' paths, not on the documents'.

Null or empty text: no licence of its own. Null path: no directory, nothing inherited. Rows that repeat are scanned
alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _units as u
from ._shared import extended, written
from .decontam import INSIDE, LOWER

CLOSE, SHARE = 0.6, 0.3

# Notices of public licences and the opening paragraphs of their texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0 Universal Public Domain Dedication)."),
]


def _hashed(texts: list[str]) -> u.Words:
    data, offsets = u.utf8(pa.array(texts, pa.string()))
    return u.words(LOWER[data], offsets, INSIDE)


def vocabulary(templates=TEMPLATES) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the templates' words, and the count of each word (row) in each template."""
    w = _hashed([t for _, t in templates])
    words, at = np.unique(w.hash, return_inverse=True)
    counts = np.zeros((len(words), len(templates)))
    np.add.at(counts, (at, np.repeat(np.arange(len(templates)), np.diff(w.first))), 1)
    return words, counts


def _place(hashes: np.ndarray, words: np.ndarray, filt: np.ndarray) -> np.ndarray:
    """The row of each word in the vocabulary, or -1; filt: a bit for each possible lowest 16 bits of its hashes."""
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(filt[(hashes & u.U(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, hashes[maybe]), len(words) - 1)
    good = words[at] == hashes[maybe]
    out[maybe[good]] = at[good]
    return out


def _filter(words: np.ndarray) -> np.ndarray:
    filt = np.zeros(1 << 16, bool)
    filt[(words & u.U(0xFFFF)).astype(np.int64)] = True
    return filt


def document_frequencies(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each word of the (fixed) vocabulary."""

    def run(batches):
        total, n, filt = np.zeros(len(words), np.int64), 0, _filter(words)
        for rows, data, offsets in u.chunks(batches):
            w = u.words(LOWER[data], offsets, INSIDE)
            at = _place(w.hash, words, filt)
            doc = np.repeat(np.arange(rows.num_rows), np.diff(w.first))
            pairs = np.unique(doc[at >= 0] * len(words) + at[at >= 0])
            total += np.bincount(pairs % len(words), minlength=len(words))
            n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(words)).astype(np.int32)), pa.array(np.append(n, total))], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    df = np.zeros(len(words) + 1, np.int64)
    for r in rows:
        df[r.word + 1] = r.n
    return int(df[0]), df[1:]


def cosines(hashes: np.ndarray, unit: np.ndarray, n_units: int, words: np.ndarray, filt: np.ndarray, idf: np.ndarray, other: float, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best template of each unit (line or text) and its cosine; vectors: unit-length templates times idf, by word."""
    key = np.sort((unit.astype(u.U) << u.U(40)) | (hashes >> u.U(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    of = (key[at] >> u.U(40)).astype(np.int64)
    norm = np.bincount(of, (tf * other) ** 2, n_units)
    place = _place(hashes, words, filt)
    known = place >= 0
    pairs, tf = np.unique(unit[known] * len(words) + place[known], return_counts=True)
    of, word = pairs // len(words), pairs % len(words)
    norm += np.bincount(of, (tf * idf[word]) ** 2 - (tf * other) ** 2, n_units)
    dots = np.zeros((n_units, vectors.shape[1]))
    if len(of):
        first = np.flatnonzero(np.diff(of, prepend=-1))
        dots[of[first]] = np.add.reduceat(tf[:, None] * vectors[word], first, axis=0)
    cosine = dots / np.sqrt(np.maximum(norm, 1e-12))[:, None]
    best = cosine.argmax(axis=1) if n_units else np.zeros(0, int)
    return best, cosine[np.arange(n_units), best]


def own_licenses(docs: DataFrame, templates=TEMPLATES, close: float = CLOSE, share: float = SHARE) -> DataFrame:
    """docs without their text, with own_license, own_score and is_licence_file."""
    words, counts = vocabulary(templates)
    n, df = document_frequencies(docs, words)
    idf, other = np.log((1 + n) / (1 + df)) + 1, float(np.log(1 + n) + 1)
    weighted = counts * idf[:, None]
    vectors = weighted / np.linalg.norm(weighted, axis=0) * idf[:, None]
    names, filt = [x for x, _ in templates], _filter(words)

    def run(batches):
        for rows, data, offsets in u.chunks(batches):
            w = u.words(LOWER[data], offsets, INSIDE)
            n_docs = rows.num_rows
            doc = np.repeat(np.arange(n_docs), np.diff(w.first))
            line = np.searchsorted(np.sort(np.concatenate((offsets[:-1], np.flatnonzero(data == 10)))), w.start, "right")
            line = np.cumsum(np.diff(line, prepend=-1) != 0) - 1 if len(line) else line
            n_lines = int(line[-1]) + 1 if len(line) else 0
            best_line, of_line = cosines(w.hash, line, n_lines, words, filt, idf, other, vectors)
            best_doc, of_doc = cosines(w.hash, doc, n_docs, words, filt, idf, other, vectors)
            first_word = np.flatnonzero(np.diff(line, prepend=-1)) if n_lines else np.zeros(0, int)
            line_doc, line_size = doc[first_word], np.diff(np.append(first_word, len(line)))
            matching = np.bincount(line_doc, line_size * (of_line >= close - 1e-9), n_docs)
            order = np.lexsort((best_line, -np.round(of_line, 9), line_doc))
            score, template = np.round(of_doc, 9), best_doc.copy()
            lead = order[np.flatnonzero(np.diff(line_doc[order], prepend=-1))] if n_lines else order
            better = np.round(of_line[lead], 9) > score[line_doc[lead]]
            score[line_doc[lead[better]]], template[line_doc[lead[better]]] = np.round(of_line[lead[better]], 9), best_line[lead[better]]
            own = score >= close - 1e-9
            is_file = own & ((of_doc >= close - 1e-9) | (matching >= share * np.maximum(np.diff(w.first), 1)))
            keep = [i for i, c in enumerate(rows.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in keep), pa.array([names[t] if o else None for t, o in zip(template, own, strict=True)], pa.string()), pa.array(np.where(own, score, 0.0)), pa.array(is_file)],
                [*(rows.schema.names[i] for i in keep), "own_license", "own_score", "is_licence_file"],
            )

    docs = docs.drop("own_license", "own_score", "is_licence_file")
    return docs.mapInArrow(run, extended(docs.drop("text"), {"own_license": "string", "own_score": "double", "is_licence_file": "boolean"}))


def ancestors(directory: Column) -> Column:
    """A directory and all above it, the root ("") last."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inherit(scanned: DataFrame, id_col: str = "doc_id", path_col: str = "path") -> DataFrame:
    """scanned with license and license_from: own (""), or the directory it is inherited from, or null."""
    rows = scanned.withColumn("_dir", F.regexp_replace(F.col(path_col), "/?[^/]*$", ""))
    files = rows.where("is_licence_file and _dir is not null").groupBy("_dir").agg(F.min(F.struct((-F.col("own_score")).alias("score"), F.col(id_col).alias("id"), F.col("own_license").alias("license"))).alias("file")).select(F.col("_dir").alias("_above"), F.col("file.license").alias("_license"))
    up = rows.where("_dir is not null").select("_dir").distinct().select("_dir", F.posexplode(ancestors(F.col("_dir"))).alias("_steps", "_above"))
    nearest = up.join(files, "_above").groupBy("_dir").agg(F.min(F.struct("_steps", "_above", "_license")).alias("_found"))
    own = F.col("own_license").isNotNull()
    return (
        rows.join(nearest, "_dir", "left")
        .withColumns({"license": F.when(own, F.col("own_license")).otherwise(F.col("_found._license")), "license_from": F.when(own, F.lit("")).otherwise(F.concat(F.col("_found._above"), F.lit("/")))})
        .drop("_dir", "_found")
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, is_licence_file, license, license_from, from doc_id, path and text."""
    return inherit(written(own_licenses(docs.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text")))))


def with_paths(docs: DataFrame) -> DataFrame:
    """documents have no path: source is their directory, lang the one below, doc_id the file."""
    return docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))))
