"""Ranked lexical search of many items at once, with the sums that items share computed once.

1. One pass reduces every document to its number of terms and the counts of those terms that some item holds.
2. Terms that occur in the same items are one unit. In the units of all items, ordered by frequency, neighbouring pairs
   that several items share are replaced by a node again and again. So a term set that items share becomes one node, made
   of smaller shared nodes; the nodes form a graph in which every sum is used by all items that need it.
3. Per block of documents the graph is evaluated from the terms upwards, one row of partial scores per node. An item's
   scores are the sum of its topmost nodes. The ten best documents per item stay; blocks, tasks and groups of tasks each
   hand on ten.

Items come in blocks of bounded size, each a pass of its own over the documents.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import freeze
from .words import runs, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Items and their terms in one block.
BLOCK_ITEMS, BLOCK_TERMS = 20_000, 1_000_000
#: Numbers that one block of partial scores may hold.
CELLS = 4_000_000
#: Groups of tasks whose best documents are merged before all are.
MERGERS = 64

COUNTED = "doc_id long, n long, terms binary, counts binary"


class Sharing:
    """The graph of shared sums of some items, each a list of distinct term numbers.

    Rows: first the terms, then the units of several terms, then nodes. `steps` lists, bottom up, ranges of rows with the
    rows that each is the sum of; `tops` are the rows whose sum is an item's score.
    """

    def __init__(self, items: list[list[int]], n_terms: int):
        holders: dict[int, list[int]] = defaultdict(list)
        for i, terms in enumerate(items):
            for t in terms:
                holders[t].append(i)
        units: dict[tuple, list[int]] = defaultdict(list)
        for t in sorted(holders):
            units[tuple(holders[t])].append(t)
        self.n_terms, self.n_rows = n_terms, n_terms
        self._plain = sum(max(0, len(terms) - 1) for terms in items)
        self.steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        lists: list[list[int]] = [[] for _ in items]
        sums: list[list[int]] = []
        # units that many items hold come first in every item
        for owners, terms in sorted(units.items(), key=lambda u: (-len(u[0]), u[1])):
            if len(terms) == 1:
                row = terms[0]
            else:
                row = n_terms + len(sums)
                sums.append(terms)
            for i in owners:
                lists[i].append(row)
        self._add(sums)
        while True:
            pairs = Counter(p for own in lists for p in set(zip(own, own[1:], strict=False)))
            shared = {p for p, n in pairs.items() if n > 1}
            if not shared:
                break
            # of two overlapping pairs the one that more items share is taken
            made: dict[tuple[int, int], int] = {}
            rank = {p: (-pairs[p], p) for p in shared}
            for i, own in enumerate(lists):
                taken: list[int] = []
                k = 0
                while k < len(own):
                    here = (own[k], own[k + 1]) if k + 1 < len(own) else None
                    ahead = (own[k + 1], own[k + 2]) if k + 2 < len(own) else None
                    if here in shared and not (ahead in shared and rank[ahead] < rank[here]):
                        taken.append(made.setdefault(here, self.n_rows + len(made)))
                        k += 2
                    else:
                        taken.append(own[k])
                        k += 1
                lists[i] = taken
            self._add([list(p) for p in made])
        self.tops = lists

    def _add(self, sums: list[list[int]]) -> None:
        if sums:
            flat = np.array([r for s in sums for r in s], dtype=np.int64)
            starts = np.cumsum([0, *[len(s) for s in sums]])[:-1]
            self.steps.append((self.n_rows, self.n_rows + len(sums), flat, starts))
            self.n_rows += len(sums)

    def additions(self) -> tuple[int, int]:
        """Additions per document with the graph and without."""
        made = sum(len(flat) - len(starts) for _, _, flat, starts in self.steps)
        return made + sum(max(0, len(t) - 1) for t in self.tops), self._plain

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Items x documents, from terms x documents."""
        width = rows.shape[1]
        every = np.empty((self.n_rows, width), dtype=np.int64)
        every[: self.n_terms] = rows
        for lo, hi, flat, starts in self.steps:
            np.add.reduceat(every[flat], starts, axis=0, out=every[lo:hi])
        out = np.zeros((len(self.tops), width), dtype=np.int64)
        some = [i for i, t in enumerate(self.tops) if t]
        # item by item blocks, so that the gathered rows stay few
        lo = 0
        while lo < len(some):
            hi, held = lo, 0
            while hi < len(some) and (hi == lo or held + len(self.tops[some[hi]]) <= self.n_rows):
                held += len(self.tops[some[hi]])
                hi += 1
            flat = np.concatenate([self.tops[i] for i in some[lo:hi]])
            starts = np.cumsum([0, *[len(self.tops[i]) for i in some[lo:hi]]])[:-1]
            out[some[lo:hi]] = np.add.reduceat(every[flat], starts, axis=0)
            lo = hi
        return out


class Items:
    """A block of items with its terms and the graph of their sums."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]]):
        self.ids = [r[0] for r in rows]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *[r[1] for r in rows]]))
        self.held = [np.searchsorted(self.terms, r[1]).tolist() for r in rows]


def _terms_of_items():
    import pyarrow as pa

    def run(batches):
        for batch, texts in runs(batches):
            words, at = word_hashes(texts, "letters")
            sets = [np.unique(words[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "terms"]
            )

    return run


def item_blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS):
    """All items in blocks; one that holds more terms than a block may has a block of its own."""
    slim = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    terms = freeze(slim.mapInArrow(_terms_of_items(), "item_id long, terms binary"))
    held: list[tuple] = []
    size = 0
    for row in terms.where(F.length("terms") > 0).orderBy("item_id", "terms").toLocalIterator():
        own = np.frombuffer(bytes(row.terms), dtype=np.uint64)
        if held and (len(held) >= most_items or size + len(own) > most_terms):
            yield Items(held)
            held, size = [], 0
        held.append((row.item_id, own))
        size += len(own)
    if held:
        yield Items(held)


def _count(shared_terms):
    """Per document the number of terms, and which item terms it holds how often."""
    import pyarrow as pa

    def run(batches):
        wanted = shared_terms.value
        for batch, texts in runs(batches):
            words, at = word_hashes(texts, "letters")
            place = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
            hit = wanted[place] == words
            text = np.repeat(np.arange(len(texts)), np.diff(at))[hit]
            cell, n = np.unique(text * len(wanted) + place[hit], return_counts=True)
            bounds = np.searchsorted(cell, np.arange(len(texts) + 1) * len(wanted))
            term, n = (cell % len(wanted)).astype(np.int32), n.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(at), pa.int64()),
                    pa.array([term[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                    pa.array([n[lo:hi].tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _holders(n_terms: int):
    """Documents per term, added up within the task."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("terms")).to_pylist()
            total += np.bincount(np.frombuffer(b"".join(held), dtype=np.int32), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    return run


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m))."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Best:
    """The best documents of every item so far: highest score first, of equal scores the smallest id."""

    def __init__(self, n_items: int, most: int):
        self.most = most
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.floor = np.zeros(n_items, dtype=np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """`floor` is the last score that can still rank; scores of 0 never do."""
        item, at = np.nonzero(scores >= np.maximum(self.floor, 1)[:, None])
        if not len(item):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[item[len(self.item) :], at]])
        doc = np.concatenate([self.doc, docs[at]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        keep = place < self.most
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = place[keep] == self.most - 1
        self.floor[self.item[full]] = self.score[full]


#: Stands for a missing doc_id while documents are ordered: behind all others.
NO_ID = (1 << 63) - 1


def _rank(shared_graph, shared_weights, n_docs: int, n_words: int, most: int):
    import pyarrow as pa

    def run(batches):
        graph, weight = shared_graph.value, shared_weights.value
        best = Best(len(graph.tops), most)
        width = max(1, CELLS // max(1, graph.n_rows + len(graph.tops)))
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("terms")).to_pylist()
            counts = batch.column(batch.schema.get_field_index("counts")).to_pylist()
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            m = 10 + 90 * n_docs * n // max(1, n_words)
            some = np.array([k for k, t in enumerate(held) if t], dtype=np.int64)
            for lo in range(0, len(some), width):
                rows = some[lo : lo + width]
                term = np.frombuffer(b"".join(held[r] for r in rows), dtype=np.int32)
                tf = np.frombuffer(b"".join(counts[r] for r in rows), dtype=np.int32).astype(np.int64)
                column = np.repeat(np.arange(len(rows)), [len(held[r]) // 4 for r in rows])
                cells = np.zeros((graph.n_terms, len(rows)), dtype=np.int64)
                cells[term, column] = contributions(weight[term], tf, m[rows][column])
                best.add(graph.scores(cells), ids[rows])
        none = best.doc == NO_ID
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int64()), pa.array(best.doc, pa.int64(), mask=none), pa.array(best.score, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return run


def _top(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank(docs: DataFrame, items: DataFrame, most: int = 10, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` best documents of every item, from rank 1.

    Terms are runs of ASCII letters and digits and of non-ASCII symbols, A-Z lowered. With N documents that have a term, L
    terms in all and df documents that hold a term, its weight is floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n
    terms has m = 10 + (90 n N) div L; its score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's distinct
    terms. Scores of 0 do not rank, equal scores rank by doc_id, a NULL doc_id last. NULL and blank texts match nothing.
    Every row of items is an item, and every row of docs a document, also if it repeats an id. No rows give no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for block in item_blocks(items, most_items, most_terms):
        n_terms = len(block.terms)
        counted = freeze(slim.mapInArrow(_count(spark.sparkContext.broadcast(block.terms)), COUNTED))
        n_docs, n_words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row per term of the block
        held = counted.select("terms").mapInArrow(_holders(n_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = np.zeros(n_terms, dtype=np.int64)
        for row in held.collect():
            weight[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
        graph = spark.sparkContext.broadcast(Sharing(block.held, n_terms))
        found = counted.mapInArrow(
            _rank(graph, spark.sparkContext.broadcast(weight), n_docs, n_words, most), "item long, doc_id long, score long"
        )
        found = found.withColumn("merger", F.pmod(F.spark_partition_id(), F.lit(MERGERS)))
        top = _top(_top(found, ["item", "merger"], most).drop("rank"), ["item"], most)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        ranked = freeze(top.join(names, "item").select("item_id", "rank", "doc_id", "score"))
        out = ranked if out is None else out.union(ranked)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


SQL = r"""WITH doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tfs AS (SELECT doc_id, t, count(*) AS tf FROM doc_words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
all_docs AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
dfs AS (SELECT t, count(*) AS df FROM tfs GROUP BY t),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, all_docs),
parts AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_words))) AS part
  FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (t), all_docs),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM item_terms JOIN parts USING (t) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
