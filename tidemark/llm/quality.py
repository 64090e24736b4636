"""Quality rules: counts per document, and how far its characters and common words are from those of any language.

The reference of a language holds the shares of 14 character classes and of its `COMMON` most frequent words over all
documents labelled with it. A document is measured against every language by the Jensen-Shannon distance (the root of
the divergence in bits, 0 to 1), and it is kept if any one language accepts both, so a wrong or missing label does no
harm. Short documents are noisy: a distance only counts from a least length on.

Most words of any text are not common ones, so a text without a single common word is far less than 1 away. The limit
for words therefore comes from the reference: the distance of a text that has its common words `FAINT` times as often.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh
from .words import grams, runs, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES = 14
#: Common words of a language.
COMMON = 50
#: Least length for a verdict, in characters and in words, and the distance of characters that turns a document down.
LEAST_CHARS, LEAST_WORDS = 200, 100
FAR_CHARS = 0.30
#: A text with this part of the common words that a language leads to expect, or less, is turned down by its words.
FAINT = 0.05
#: Common words that hold a smaller share of all words (as without blanks between words) cannot tell.
TELLING = 0.10
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 500_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def class_table() -> np.ndarray:
    """Class of every byte; bytes that continue a character have none (255)."""
    table = np.full(256, 9, dtype=np.uint8)
    groups = [b" ", b"\t\n\x0b\f\r", b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b".,;:?!", b"'\"()[]{}-", SYMBOLS]
    for k, group in enumerate(groups):
        table[list(group)] = k
    table[0x80:0xC0] = 255
    table[0xC0:0xD0], table[0xD0:0xE0], table[0xE0:0xF0], table[0xF0:] = 10, 11, 12, 13
    return table


def class_counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters of each class, one row per text; `bounds` are the byte offsets of the texts."""
    kind = class_table()[raw].astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known = kind != 255
    flat = np.bincount(owner[known] * CLASSES + kind[known], minlength=(len(bounds) - 1) * CLASSES)
    return flat.reshape(-1, CLASSES)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A-Z lowered words as 63-bit hashes, their text, words of each text)."""
    words, at = word_hashes(texts, "blank_fold")
    n_words = np.diff(at)
    return (words >> np.uint64(1)).astype(np.int64), np.repeat(np.arange(len(texts)), n_words), n_words


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), bounds


def _tally(batches):
    """(lang, key, n): words by hash, all words as -1, characters of class c as -2 - c."""
    import pandas as pd
    import pyarrow as pa

    kept = []

    def squeezed():
        return pd.concat(kept).groupby(["lang", "key"], sort=False, as_index=False)["n"].sum()

    held = 0
    for batch, texts in runs(batches):
        raw, bounds = joined(texts)
        key, owner, n_words = words_of(texts)
        classes = class_counts(raw, bounds)
        labels = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for lang in {x for x in labels if x is not None}:
            rows = np.array([x == lang for x in labels])
            words, n = np.unique(key[rows[owner]], return_counts=True)
            words = np.concatenate([words, [-1], -2 - np.arange(CLASSES)])
            n = np.concatenate([n, [n_words[rows].sum()], classes[rows].sum(axis=0)])
            kept.append(pd.DataFrame({"lang": lang, "key": words, "n": n}))
            held += len(n)
        if held > 1_000_000:
            kept = [squeezed()]
            if len(kept[0]) > HELD_WORDS:
                yield pa.RecordBatch.from_pandas(kept.pop(), preserve_index=False)
            held = sum(map(len, kept))
    if kept:
        yield pa.RecordBatch.from_pandas(squeezed(), preserve_index=False)


def references(docs: DataFrame) -> dict:
    """Per language the class shares, the common words, their shares and the limit; from all labelled documents.

    The driver gets COMMON words and the classes per distinct label.
    """
    rows = docs.select("lang", "text").where("lang is not null")
    counts = rows.mapInArrow(_tally, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", F.col("key") < 0).orderBy(F.desc("n"), "key"))
    rows = counts.withColumn("k", rank).where(F.col("k") <= COMMON).select("lang", "key", "n").collect()
    out: dict = {}
    for lang in sorted({r.lang for r in rows}):
        own = {r.key: r.n for r in rows if r.lang == lang}
        chars = np.array([own.get(-2 - c, 0) for c in range(CLASSES)], dtype=float)
        words = np.array(sorted(k for k in own if k >= 0), dtype=np.int64)
        shares = np.array([own[w] for w in words], dtype=float) / max(1, own.get(-1, 0))
        if chars.sum() and own.get(-1, 0):
            word_shares = np.append(shares, max(0.0, 1 - shares.sum()))
            out[lang] = (chars / chars.sum(), words, word_shares, word_limit(word_shares))
    return out


def word_limit(shares: np.ndarray) -> float:
    """Distance from which words speak against a language; `shares` are those of its common words, and the rest."""
    if 1 - shares[-1] < TELLING:
        return np.inf
    faint = FAINT * shares
    faint[-1] = 1 - faint[:-1].sum()
    return float(distance(faint, shares))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""

    def entropy(x):
        return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=-1)

    return np.sqrt(np.clip(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2, 0, 1))


def divergences(texts: list[bytes], refs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest distance of characters and of common words to any language, 0 where the text is too short to tell; and
    whether a language accepts both."""
    raw, bounds = joined(texts)
    chars = class_counts(raw, bounds)
    key, owner, n_words = words_of(texts)
    n_chars = chars.sum(axis=1)
    few_chars, few_words = n_chars < LEAST_CHARS, n_words < LEAST_WORDS
    by_chars, by_words = np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    accepted = np.full(len(texts), not refs)
    for shares, words, word_shares, limit in refs.values():
        far_chars = distance(chars / np.maximum(n_chars, 1)[:, None], shares)
        at = np.minimum(np.searchsorted(words, key), len(words) - 1) if len(words) else np.zeros(len(key), dtype=np.int64)
        hit = words[at] == key if len(words) else np.zeros(len(key), dtype=bool)
        width = len(words) + 1
        found = np.bincount(owner[hit] * width + at[hit], minlength=len(texts) * width).reshape(-1, width).astype(float)
        found[:, -1] = n_words - found.sum(axis=1)
        far_words = distance(found / np.maximum(n_words, 1)[:, None], word_shares)
        accepted |= (few_chars | (far_chars < FAR_CHARS)) & (few_words | (far_words < limit))
        by_chars, by_words = np.minimum(by_chars, far_chars), np.minimum(by_words, far_words)
    by_chars[few_chars | ~np.isfinite(by_chars)] = 0.0
    by_words[few_words | ~np.isfinite(by_words)] = 0.0
    return by_chars, by_words, accepted


def counts(texts: list[bytes]) -> np.ndarray:
    """COUNTS per text: words, their characters, symbols, repeated lines, words in repeated three-word windows."""
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    words, at = word_hashes(texts, "blank")
    out[:, 0] = np.diff(at)
    windows = grams(words, 3)
    for k, text in enumerate(texts):
        blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\f", b"\r")))
        out[k, 1] = len(text.decode("utf-8", "replace")) - blanks
        seen = set()
        for line in text.split(b"\n"):
            if line in seen:
                out[k, 3] += 1
            elif line and not line.isspace():
                seen.add(line)
        n = at[k + 1] - at[k]
        if n >= 4:
            own = windows[at[k] : at[k + 1] - 2]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(len(own), dtype=bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                marked = np.zeros(n, dtype=bool)
                for shift in range(3):
                    marked[shift : shift + len(own)] |= twice
                out[k, 4] = marked.sum()
    raw, bounds = joined(texts)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    summed = np.concatenate(([0], np.cumsum(symbol[raw])))
    out[:, 2] = summed[bounds[1:]] - summed[bounds[:-1]]
    return out


def assess(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not base_failed and a
    language for which both distances are below its limits. A NULL text counts as empty (all counts 0, base_failed). Without any labelled document
    there is no reference and no distance. New names are underscored if the documents have them.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    refs = references(docs) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    kinds = [*[(n, T.LongType()) for n in COUNTS], ("char_distance", T.DoubleType()), ("word_distance", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    names = [fresh(docs, n) for n, _ in kinds]

    def run(batches):
        own = shared.value
        for batch, texts in runs(batches):
            found = counts(texts)
            chars, words, accepted = divergences(texts, own)
            failed = (found[:, 0] < 50) | (100 * found[:, 4] > 50 * found[:, 0])
            kept = ~failed & accepted
            added = [*found.T, chars, words, failed, kept]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, (_, t) in zip(names, kinds, strict=True)]])
    return docs.mapInArrow(run, schema)


#: The counts as SQL (the verdict has none).
SQL_COUNTS = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(0, 3) t(d) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words
FROM w JOIN l USING (doc_id) LEFT JOIN marked USING (doc_id)"""
