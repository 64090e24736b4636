"""License scans by diagonal voting.

All rolling word triples of a text are hashed and joined with the triples of the license notices. A match at text
position p and template position t votes for the diagonal p - t. Neighbouring diagonals (words added or left out) are
merged, and diagonals with enough votes are verified on the words themselves: the notice is aligned with the span, and
of notices on the same words that one holds which they contradict least.
"""

from __future__ import annotations

import re
import sys
from itertools import product

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, rows_with_bit
from .frames import freeze
from .words import grams, runs, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 3
#: Diagonals at most half a notice apart belong together, and always those this far apart.
DRIFT = 3
#: Share of a notice's triples that must vote, and of its words that must be found where they voted.
VOTES, COVER = 0.5, 0.8
WORD = rb"[0-9a-z\x80-\xff]+"

# Phrases and labels of the base rule.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Notices as their licenses state them.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

# The licenses of the two families below, with the ways in which their names are written.
COMMONS = {
    "cc-by": [["attribution"]],
    "cc-by-sa": [["attribution"], ["sharealike", "share alike"]],
    "cc-by-nd": [["attribution"], ["noderivatives", "no derivatives", "noderivs"]],
    "cc-by-nc": [["attribution"], ["noncommercial", "non commercial"]],
    "cc-by-nc-sa": [["attribution"], ["noncommercial", "non commercial"], ["sharealike", "share alike"]],
    "cc-by-nc-nd": [["attribution"], ["noncommercial", "non commercial"], ["noderivatives", "no derivatives", "noderivs"]],
}
# (label, word before "general", version; None where a notice names none)
GNU = [
    ("gpl", "", None), ("gpl-2", "", "2"), ("gpl-3", "", "3"), ("lgpl", "lesser", None), ("lgpl", "lesser", "2 1"),
    ("lgpl", "lesser", "3"), ("agpl", "affero", None), ("agpl-3", "affero", "3"),
]


def families() -> list[tuple[str, str]]:
    """Notices of licenses that differ in a word or two; each is spelled out, so that the right one fits best."""
    out = []
    for label, parts in COMMONS.items():
        for names in product(*parts):
            out.append((label, f"this work is licensed under a creative commons {' '.join(names)} 4 0 international license"))
        out.append((label, f"licensed under {label.replace('-', ' ')} 4 0"))
    for label, kind, version in GNU:
        name = " ".join(f"the gnu {kind} general public license".split())
        grant = f"this program is free software you can redistribute it and or modify it under the terms of {name}"
        if version is None:
            out += [(label, f"this work is licensed under {name}"), (label, grant)]
        else:
            by = f"as published by the free software foundation either version {version} of the license or at your option any later version"
            out += [(label, f"this work is licensed under {name} version {version}"), (label, f"{grant} {by}")]
            out.append((label, f"{grant} version {version} as published by the free software foundation"))
    return out


FOUND = "key long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def templates() -> list[tuple[str, list[bytes], bool]]:
    """(label, words, is a phrase of the base rule)."""
    return [(label, text.encode().split(), k < len(PHRASES)) for k, (label, text) in enumerate(PHRASES + NOTICES + families())]


def template_grams(spark: SparkSession) -> DataFrame:
    """(h, tmpl, tpos, grams): one row per triple of each template; its size is fixed by the lists above."""
    rows = []
    for k, (_, words, _) in enumerate(templates()):
        hashes = grams(word_hashes([b" ".join(words)], "letters")[0], WIDTH).view(np.int64)
        rows += [(int(h), k, t, len(hashes)) for t, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "h long, tmpl int, tpos int, grams int")


def _hashed(batches):
    """(key, triples) with the hash of every rolling triple of the text."""
    import pyarrow as pa

    for batch, texts in runs(batches):
        words, at = word_hashes(texts, "letters")
        every = grams(words, WIDTH).view(np.int64)
        n = np.maximum(np.diff(at) - WIDTH + 1, 0)
        # Triples that reach into the next text are left out.
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[owner] if n.sum() else np.zeros(0, dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[place] if n.sum() else np.zeros(0, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "triples"])


def _counted(batches):
    """(doc_id, key, n_words) of every row."""
    import pyarrow as pa

    for batch, texts in runs(batches):
        at = word_hashes(texts, "letters")[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64))], names=["doc_id", "key", "n_words"])


def aligned(words: list[bytes], own: list[bytes]) -> tuple[int, int, int, int]:
    """Best local alignment of a notice with words: (matches, other words within, first word, word after the last).

    A match counts one; a word that is inserted, left out or replaced costs one. The first scan holds one row and
    finds where the best alignment ends; as no word costs less than a match brings, that alignment lies within twice
    the notice's length, where its path is followed back.
    """
    codes = {w: k for k, w in enumerate(dict.fromkeys(own))}
    notice = np.array([codes[w] for w in own])
    text = [codes.get(w, -1) for w in words]
    steps = np.arange(len(own) + 1)

    def advance(row: np.ndarray, word: int) -> np.ndarray:
        new = np.zeros(len(own) + 1, dtype=np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(notice == word, 1, -1), row[1:] - 1)
        return np.maximum.accumulate(np.maximum(new, 0) + steps) - steps

    row, best, end = np.zeros(len(own) + 1, dtype=np.int64), 0, 0
    for i, word in enumerate(text):
        row = advance(row, word)
        if row.max() > best:
            best, end = int(row.max()), i + 1
    if not best:
        return 0, 0, 0, 0
    start = max(0, end - 2 * len(own))
    table = [np.zeros(len(own) + 1, dtype=np.int64)]
    for word in text[start:end]:
        table.append(advance(table[-1], word))
    i, j, matches = end - start, int(table[-1].argmax()), 0
    while table[i][j] > 0:
        hit = i > 0 and j > 0 and text[start + i - 1] == notice[j - 1]
        if i and j and table[i][j] == table[i - 1][j - 1] + (1 if hit else -1):
            matches += hit
            i, j = i - 1, j - 1
        elif i and table[i][j] == table[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return matches, end - start - i - matches, start + i, end


def _holding(fits: list[tuple[int, float, str, int, int]]) -> list[tuple[int, float, str, int, int]]:
    """Fits (strength, cover, label, first, end) that no better fit on the same words displaces; equal ones all hold."""
    held = []
    for fit in sorted(fits, key=lambda f: (-f[0], -f[1], f[2], f[3])):
        _, _, _, first, end = fit
        rivals = [h for h in held if 2 * (min(end, h[4]) - max(first, h[3])) > min(end - first, h[4] - h[3])]
        if all(fit[:2] >= h[:2] for h in rivals):
            held.append(fit)
    return held


def _verified(batches):
    """What the words of a text confirm of its voted spans."""
    import pyarrow as pa

    known = templates()
    for batch, texts in runs(batches):
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        rows = []
        for key, text, votes in zip(batch.column(0).to_pylist(), texts, spans, strict=True):
            words = re.findall(WORD, text.lower())
            base, fits = [], []
            for vote in votes:
                label, own, phrase = known[vote["tmpl"]]
                diagonals = vote["diagonals"]
                if phrase:
                    base += [(d, label) for d in diagonals if d >= 0 and words[d : d + len(own)] == own]
                    continue
                at = max(0, min(diagonals))
                matches, other, first, end = aligned(words[at : max(diagonals) + len(own)], own)
                if matches >= COVER * len(own):
                    # what the words confirm, less what they lack and what they say besides
                    strength = 2 * matches - len(own) - other
                    fits.append((strength, matches / len(own), label, at + first, at + end))
            held = _holding(fits)
            places = sorted(p for p, _ in base)
            base_labels = {x for _, x in base}
            labels = base_labels | {label for _, _, label, _, _ in held}
            score = 1.0 if base else max((cover for _, cover, _, _, _ in held), default=0.0)
            if labels:
                rows.append((key, len(base), places[0] if base else None, places[-1] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score))
        if rows:
            names = ["key", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Words are runs of ASCII letters and digits (A-Z lowered) and of non-ASCII characters. Places and votes are found
    once per text (by its hash), so copies and repeated rows get the same answer. A NULL or blank text has no words:
    n_base 0, NULL places, empty labels, score 0. The score is the largest share of a notice's words found, 1 at a place
    of the base rule. Of notices that fit the same words the strongest one gives its label: matched words less missing
    ones and less other words between them; equally strong ones all do.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    triples = slim.select("key", "text").mapInArrow(_hashed, "key long, triples array<long>")
    triples = triples.select("key", F.posexplode("triples").alias("pos", "h"))
    # The template table is fixed text of a few hundred rows.
    votes = triples.join(F.broadcast(template_grams(spark)), "h")
    votes = votes.select("key", "tmpl", "grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).distinct()
    diagonals = votes.groupBy("key", "tmpl", "grams", "diagonal").agg(F.collect_set("tpos").alias("hits"))
    order = Window.partitionBy("key", "tmpl").orderBy("diagonal")
    gap = F.greatest(F.lit(DRIFT), F.expr(f"(grams + {WIDTH - 1}) div 2"))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    # A base phrase has one place per diagonal, so its diagonals are never merged.
    split = apart | (F.col("tmpl") < len(PHRASES))
    diagonals = diagonals.withColumn("new", split.cast("int"))
    merged = diagonals.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("key", "tmpl", "grams", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.sort_array(F.collect_list("diagonal")).alias("diagonals"),
    )
    enough = F.when(F.col("tmpl") < len(PHRASES), F.lit(1.0)).otherwise(F.lit(VOTES))
    merged = merged.where(F.size("hits") >= enough * F.col("grams"))
    spans = freeze(merged.groupBy("key").agg(F.collect_list(F.struct("tmpl", "diagonals")).alias("spans")))
    # Only texts that may have spans are moved. Rows with one key have one text.
    voted = rows_with_bit(slim.select("key", "text"), "key", bitmap(spans, "key"))
    texts = voted.join(spans, "key").groupBy("key").agg(F.min("text").alias("text"), F.first("spans").alias("spans"))
    found = texts.mapInArrow(_verified, FOUND)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(_counted, f"doc_id {kind}, key long, n_words long")
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


SQL_BASE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p(label, phrase) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']),
  ('cc-by-nc', ['cc', 'by', 'nc'])),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w), p
  WHERE words[i : i + len(phrase) - 1] = phrase),
found AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN found USING (doc_id)"""
