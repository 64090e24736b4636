"""Benchmark decontamination: short test items are searched inside long documents.

Containment of an item in a document hardly shows in their similarity, as documents are so much larger. Documents are
therefore partitioned by the size of their shingle set (powers of two), and a partition's MinHash has at least twice as
many bins as its documents have shingles: the smallest hash of every bin is the signature, and four of five shingles of a
document are in it. The item's signature for the same bins is looked up. An item of `FEW` shingles or less is looked up
by all of them, against all shingles. Every candidate is decided by its exact shingles, as words.
"""

from __future__ import annotations

import re
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import parts_for
from .words import runs, shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Items of a block; a block's index is broadcast, further blocks take further passes.
BLOCK_ITEMS = 20_000
FEW = 15
WORD = rb"[0-9a-z\x80-\xff]+"
FOUND = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def tokens(text: bytes) -> list[bytes]:
    return re.findall(WORD, text.lower())


def exact_shingles(words: list[bytes], width: int) -> set:
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def signature(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Smallest hash of every bin of the leading `bits` bits; the shingles are sorted."""
    bins = shingles >> np.uint64(64 - bits)
    return shingles[np.concatenate(([True], bins[1:] != bins[:-1]))] if len(shingles) else shingles


def size_class(n: int) -> int:
    return max(6, int(n).bit_length() + 1)


class Index:
    """Items of one block by shingle width (fewer than five words: the item is one shingle of all its words)."""

    def __init__(self, items: list[tuple[int, bytes]], width: int, part: int, whole: int):
        self.width, self.part, self.whole = width, part, whole
        words = [tokens(text) for _, text in items]
        self.ids = [i for i, _ in items]
        self.widths = [min(width, len(w)) for w in words]
        self.exact = [exact_shingles(w, k) if k else set() for w, k in zip(words, self.widths, strict=True)]
        self.by_width = {}
        for k in sorted({k for k in self.widths if k}):
            own = [i for i, w in enumerate(self.widths) if w == k]
            sets = shingle_sets([b" ".join(words[i]) for i in own], k, "letters")
            few = [(s, i) for s, i in zip(sets, own, strict=True) if len(s) <= FEW]
            self.by_width[k] = (few, [(s, i) for s, i in zip(sets, own, strict=True) if len(s) > FEW])
        self.lookups: dict = {}

    def lookup(self, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted signature hashes with their items, and the leading 16 bits that occur; bits 0 means all shingles."""
        if (k, bits) not in self.lookups:
            few, many = self.by_width[k]
            entries = [(signature(s, bits), i) for s, i in many] if bits else few
            keys = np.concatenate([np.zeros(0, np.uint64), *[s for s, _ in entries]])
            owner = np.concatenate([np.zeros(0, np.int64), *[np.full(len(s), i, dtype=np.int64) for s, i in entries]])
            order = np.argsort(keys, kind="stable")
            there = np.zeros(1 << 16, dtype=bool)
            there[keys >> np.uint64(48)] = True
            self.lookups[k, bits] = keys[order], owner[order], there
        return self.lookups[k, bits]

    def candidates(self, sets: list[np.ndarray], rows: list[int], k: int, bits: int) -> set:
        """(text number, item number) of texts whose hashes meet an item's."""
        keys, owner, there = self.lookup(k, bits)
        if not len(keys) or not rows:
            return set()
        hashes = np.concatenate([sets[r] for r in rows])
        text = np.repeat(rows, [len(sets[r]) for r in rows])
        kept = there[hashes >> np.uint64(48)]
        hashes, text = hashes[kept], text[kept]
        lo, hi = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
        return {(int(t), int(i)) for t, a, b in zip(text[hi > lo], lo[hi > lo], hi[hi > lo], strict=True) for i in owner[a:b]}

    def search(self, texts: list[bytes]):
        """(text number, item number, shingles shared) of every item that a text contains."""
        for k in self.by_width:
            sets = shingle_sets(texts, k, "letters", whole=False)
            full = [r for r, s in enumerate(sets) if len(s)]
            near = self.candidates(sets, full, k, 0)
            classes: dict[int, list[int]] = {}
            for r in full:
                classes.setdefault(size_class(len(sets[r])), []).append(r)
            for bits, rows in classes.items():
                for r in rows:
                    sets[r] = signature(sets[r], bits)
                near |= self.candidates(sets, rows, k, bits)
            mine, of = set(), -1
            for row, i in sorted(near):
                if row != of:
                    mine, of = exact_shingles(tokens(texts[row]), k), row
                shared = len(self.exact[i] & mine)
                if shared and self.whole * shared >= self.part * len(self.exact[i]):
                    yield row, i, shared


def blocks(items: DataFrame, width: int, part: int, whole: int, most: int):
    """An index per block of at most about `most` items; together they hold all items."""
    n = parts_for(items.count(), most)
    slim = items.select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    for k in range(n):
        rows = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted((r.item_id if r.item_id is not None else -1, bytes(r.text)) for r in rows), width, part, whole)


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, part: int = 80, whole: int = 100, most: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: pairs where whole * shared >= part * shingles of the item.

    Words are runs of letters and digits (ASCII, A-Z lowered) and of non-ASCII characters, so punctuation and line
    breaks do not hide a passage. Shingles are distinct. NULL and blank texts, of items too, match nothing; a repeated
    row is found again; no rows on either side give no rows. A NULL item_id is reported as -1.
    """
    import pyarrow as pa

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in blocks(items, width, part, whole, most):
        shared_index = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared_index=shared_index):
            own = shared_index.value
            for batch, texts in runs(batches):
                hits = list(own.search(texts))
                if hits:
                    rows, at, n = zip(*hits, strict=True)
                    sizes = [len(own.exact[i]) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)), pa.array([own.ids[i] for i in at], pa.int64()),
                            pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                            pa.array([a / b for a, b in zip(n, sizes, strict=True)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

        found = slim.mapInArrow(run, FOUND)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, width: int = 5, part: int = 80, whole: int = 100, most: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    import pyarrow as pa

    for index in blocks(items, width, part, whole, most):
        shared_index = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared_index=shared_index):
            own = shared_index.value
            for batch, texts in runs(batches):
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, _, _ in own.search(texts):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


SQL = r"""WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_sets AS (SELECT item_id, least(5, len(w)) AS k,
  list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0),
widths AS (SELECT DISTINCT k FROM item_sets),
doc_sets AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')))) AS g
  FROM doc_words, widths WHERE len(w) >= k),
flat AS (SELECT item_id, k, len(s) AS n, unnest(s) AS g FROM item_sets)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, count(*) AS n_shared, count(*) / n AS containment
FROM flat JOIN doc_sets USING (k, g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""
