"""Exact nearest neighbours between two sets of vectors.

A cover of two levels, pivots and pivots of pivots, puts every vector into the
cell of a near pivot.  From the radii of the item cells the triangle inequality
says for every query vector which cells can hold a result, and the vector is
sent only to the blocks of those cells.  A block pair returns its best ``k``
per query, so pairs are never written out.
Cells and block sizes follow the number of items; there is one way for all
sizes.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import freeze
from .keys import null_safe_join

# tasks get the functions of this module by value, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# a block holds about 20 times the root of the items, within these bounds
LEAST_BLOCK, MOST_BLOCK = 2_000, 200_000
# the broadcast pivots take at most this many bytes, the sample from which they come so many times more
PIVOT_BYTES, SAMPLE = 8_000_000, 8
# upper pivots that are chosen by distance, and how many of them a vector tries
_SPREAD, _TRIED = 1_024, 4
# distances held at once, and numbers of the candidate pairs whose exact scores are computed at once
_CHUNK_CELLS, _PAIR_CELLS = 1_000_000, 500_000
# items of a leaf of a block, the widest vectors and the largest share of (query, leaf) pairs for which leaves pay
_LEAF, _LEAF_WIDTH, _FEW = 256, 32, 0.5
# items whose least rough distance stands for all of them, and candidates per result beyond which rough distances are too rough
_GROUP, _TOO_MANY = 32, 32
_EPSILON, _SINGLE = float(np.finfo("float64").eps), float(np.finfo("float32").eps)


# ---- distances -------------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1.0, size)


def _rough(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances by a matrix product, and a bound of their error per row of ``left``.

    Both sides are moved to the middle of the right one first; what the product
    of the moved rows may lose, and what moving them lost, is the bound.
    """
    middle = right.mean(axis=0)
    a, b = left - middle, right - middle
    a2, b2 = (a**2).sum(1), (b**2).sum(1)
    square = a2[:, None] + b2[None, :] - 2 * a @ b.T
    width = left.shape[1] + 8
    largest = max(np.abs(left).max(initial=0.0), np.abs(right).max(initial=0.0))
    lost = np.sqrt(8 * width * _EPSILON * (a2 + b2.max(initial=0.0))) + 8 * width * _EPSILON * largest
    return np.sqrt(np.maximum(square, 0.0)), lost


def _exact(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Score of each pair of rows, higher is nearer; equal vectors always get equal scores."""
    if metric == "cosine":
        return np.abs((_unit(left) * _unit(right)).sum(1))
    return -np.sqrt(((left - right) ** 2).sum(1))


def _candidates(left: np.ndarray, right: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rough scores and a bound of their error per row of ``left``."""
    if metric == "cosine":
        scores = np.abs(_unit(left) @ _unit(right).T)
        return scores, np.full(len(left), 64 * (left.shape[1] + 8) * _EPSILON)
    distance, lost = _rough(left, right)
    return -distance, lost


def _ranked(left, right, left_ids, right_ids, row, column, k: int, metric: str) -> pd.DataFrame:
    """The best ``k`` of the candidate pairs of each query, by their exact scores."""
    step = max(1, _PAIR_CELLS // max(1, left.shape[1]))
    parts = [slice(start, start + step) for start in range(0, len(row), step)]
    score = np.concatenate([np.zeros(0), *[_exact(left[row[p]], right[column[p]], metric) for p in parts]])
    found = pd.DataFrame(
        {"query_id": left_ids[row], "item_id": right_ids[column], "score": score}
    ).sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _leaves(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where each leaf begins (and the end): halves along the widest column, again and again."""
    sizes, stack, order = [0], [np.arange(len(rows))], []
    while stack:
        part = stack.pop()
        if len(part) > most:
            own = rows[part]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            halves = np.argpartition(own[:, widest], len(part) // 2)
            stack += [part[halves[len(part) // 2:]], part[halves[: len(part) // 2]]]
        else:
            sizes.append(len(part))
            order.append(part)
    return np.concatenate(order), np.cumsum(sizes)


def _near_leaves(left: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows from boxes and a bound of their error per row."""
    square = np.zeros((len(left), len(low)))
    for j in range(left.shape[1]):
        value = left[:, j: j + 1]
        gap = np.maximum(np.maximum(low[None, :, j] - value, value - high[None, :, j]), 0.0)
        square += gap * gap
    distance = np.sqrt(square)
    largest = max(np.abs(left).max(initial=0.0), np.abs(low).max(initial=0.0), np.abs(high).max(initial=0.0))
    return distance, np.full(len(left), 8 * (left.shape[1] + 8) * _EPSILON * largest)


def _best_by_leaves(left, right, left_ids, right_ids, codes, k: int, metric: str) -> pd.DataFrame | None:
    """``_best_pairs`` by leaves of near items; None if most leaves can hold a result of most queries.

    A query's k-th distance in its nearest leaf bounds its k-th result, so only the leaves within it are compared.
    """
    left_code, right_code = codes
    order, begin = _leaves(right, _LEAF + 4 * k)
    low = np.minimum.reduceat(right[order], begin[:-1], axis=0)
    high = np.maximum.reduceat(right[order], begin[:-1], axis=0)
    step = max(1, _CHUNK_CELLS // len(low))
    best = []
    for start in range(0, len(left), step):
        part = np.arange(start, min(start + step, len(left)))
        apart, lost = _near_leaves(left[part], low, high)
        bound = np.full(len(part), np.inf)

        def compare(queries: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            items = order[begin[leaf]: begin[leaf + 1]]
            scores, rough = _candidates(left[part[queries]], right[items], metric)
            scores[left_code[part[queries]][:, None] == right_code[items][None, :]] = -np.inf
            return items, scores, rough

        nearest_leaf = apart.argmin(axis=1)
        for leaf in np.unique(nearest_leaf):
            queries = np.flatnonzero(nearest_leaf == leaf)
            _, scores, rough = compare(queries, leaf)
            if scores.shape[1] >= k:
                bound[queries] = np.partition(-scores, k - 1, axis=1)[:, k - 1] + 2 * rough
        hit = apart - lost[:, None] <= bound[:, None]
        if hit.mean() > _FEW:
            return None
        leaves, pairs = np.flatnonzero(hit.any(axis=0)), []
        for leaf in leaves:
            queries = np.flatnonzero(hit[:, leaf])
            items, scores, rough = compare(queries, leaf)
            row, column = np.nonzero((scores >= -bound[queries][:, None] - 2 * rough[:, None]) & (scores > -np.inf))
            pairs.append((part[queries[row]], items[column]))
            if leaf == leaves[-1] or sum(len(row) for row, _ in pairs) > _CHUNK_CELLS // 4:
                best.append(_ranked(left, right, left_ids, right_ids, *map(np.concatenate, zip(*pairs)), k, metric))
                pairs = []
    if not best:
        return pd.DataFrame(columns=["query_id", "item_id", "score"])
    found = pd.concat(best, ignore_index=True).sort_values(["query_id", "score", "item_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k).reset_index(drop=True)


def _best_by_groups(left, right, left_ids, right_ids, codes, k: int) -> pd.DataFrame | None:
    """``_best_pairs`` of distances in numbers of half the size; None if these do not tell the vectors apart.

    One matrix product gives half the squared distances, less what is the same for all items of a query.  The k-th
    least of the groups' minima bounds the k-th result, so only the groups within it are looked into.
    """
    width, m = left.shape[1], -(-len(right) // _GROUP)
    middle = right.mean(axis=0)
    a, b = left - middle, right - middle
    a2, b2 = (a**2).sum(1), (b**2).sum(1)
    # also false for missing values; squares stay far inside the range of the smaller numbers
    if m < 4 * k or not (max(a2.max(), b2.max()) < 1e30 and b2.max() > 1e-20):
        return None
    # what products and sums of rounded numbers may lose, what moving the rows lost, and rounding of the exact scores
    far, largest = np.sqrt(b2.max()), max(np.abs(left).max(), np.abs(right).max())
    moved = 8 * (width + 8) * _EPSILON * largest
    reach = np.sqrt(a2) + far
    lost = 2 * (width + 8) * (_SINGLE * far * reach + 8 * _EPSILON * reach**2) + moved * (reach + moved)
    a32 = np.ones((len(a), width + 1), dtype="float32")
    a32[:, :width] = a
    # the last group is filled up with items that are out of reach
    b32 = np.zeros((_GROUP * m, width + 1), dtype="float32")
    b32[: len(b), :width], b32[: len(b), width], b32[len(b):, width] = -b, b2 / 2, np.inf
    del a, b
    # the items that are the query itself
    order = np.argsort(codes[1], kind="stable")
    first = np.searchsorted(codes[1][order], codes[0])
    own = np.searchsorted(codes[1][order], codes[0], side="right") - first
    if own.sum() > _TOO_MANY * (len(left) + len(right)):
        return None
    before = np.cumsum(own) - own
    own_row, own_item = np.repeat(np.arange(len(left)), own), order[np.arange(own.sum()) + np.repeat(first - before, own)]
    best, pairs = [], []
    step = max(1, _CHUNK_CELLS // len(b32))
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        half = a32[part] @ b32.T
        these = slice(*np.searchsorted(own_row, [start, start + step]))
        half[own_row[these] - start, own_item[these]] = np.inf
        grouped = half.reshape(len(half), _GROUP, m)
        least = grouped.min(axis=1)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1].astype("float64") + 2 * lost[part]
        row, group = np.nonzero(least <= bound[:, None])
        if len(row) > _TOO_MANY * k * len(half):
            return None
        within = grouped[row, :, group]
        hit, place = np.nonzero((within <= bound[row][:, None]) & (within < np.inf))
        if len(hit) > _TOO_MANY * k * len(half):
            return None
        pairs.append((start + row[hit], place * m + group[hit]))
        if start + step >= len(left) or sum(len(row) for row, _ in pairs) > _CHUNK_CELLS // 4:
            best.append(_ranked(left, right, left_ids, right_ids, *map(np.concatenate, zip(*pairs)), k, "euclid"))
            pairs = []
    return pd.concat(best, ignore_index=True)


def _best_pairs(queries: pd.DataFrame, items: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    columns = ["query_id", "item_id", "score"]
    if queries.empty or items.empty:
        return pd.DataFrame(columns=columns)
    left = np.stack(queries["_vector"]).astype("float64")
    right = np.stack(items["_vector"]).astype("float64")
    left_ids, right_ids = queries["query_id"].to_numpy(), items["item_id"].to_numpy()
    codes = pd.factorize(np.concatenate([left_ids, right_ids]))[0]
    left_code, right_code = codes[: len(left_ids)], codes[len(left_ids):]
    # boxes hold distances only, and are worth their making for some leaves and columns
    if metric == "euclid" and len(right) > 8 * (_LEAF + 4 * k) and left.shape[1] <= _LEAF_WIDTH:
        found = _best_by_leaves(left, right, left_ids, right_ids, (left_code, right_code), k, metric)
        if found is not None:
            return found[columns]
    if metric == "euclid":
        found = _best_by_groups(left, right, left_ids, right_ids, (left_code, right_code), k)
        if found is not None:
            return found[columns]
    best = []
    step = max(1, _CHUNK_CELLS // len(right_ids))
    for start in range(0, len(left_ids), step):
        part = slice(start, start + step)
        scores, lost = _candidates(left[part], right, metric)
        scores[left_code[part][:, None] == right_code[None, :]] = -np.inf
        if scores.shape[1] > k:
            bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1: k] - 2 * lost[:, None]
        else:
            bound = np.full((scores.shape[0], 1), -np.inf)
        row, column = np.nonzero((scores >= bound) & (scores > -np.inf))
        # the rough scores choose the candidates, the exact ones their ranks
        best.append(_ranked(left, right, left_ids, right_ids, start + row, column, k, metric))
    return pd.concat(best, ignore_index=True)[columns]


# ---- cells -----------------------------------------------------------------


def _apart(rows: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances to pivots and a bound of their error; lines have their angle as distance."""
    if metric == "cosine":
        return np.arccos(np.clip(np.abs(_unit(rows) @ _unit(pivots).T), 0.0, 1.0)), np.full(len(rows), 1e-6)
    return _rough(rows, pivots)


def _cover(sample: np.ndarray, wanted: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Pivots in the order of their upper pivots, and where the pivots of each upper one begin (and the end).

    The upper pivots are those of the sample that lie farthest from all chosen
    before, so every dense region gets one; the others come as sampled.
    """
    wanted = min(wanted, len(sample))
    chosen, nearest_one = [0], _apart(sample, sample[:1], metric)[0][:, 0]
    upper = np.zeros(len(sample), dtype="int64")
    while len(chosen) < min(_SPREAD, (wanted + 1) // 2):
        far = int(nearest_one.argmax())
        if nearest_one[far] <= 0:
            break
        d = _apart(sample, sample[far: far + 1], metric)[0][:, 0]
        upper[d < nearest_one] = len(chosen)
        nearest_one = np.minimum(nearest_one, d)
        # rounding leaves a vector a little apart from itself
        nearest_one[far] = 0.0
        upper[far] = len(chosen)
        chosen.append(far)
    others = np.setdiff1d(np.arange(len(sample)), chosen)[: wanted - len(chosen)]
    members = np.concatenate([np.array(chosen, dtype="int64"), others])
    # uppers in the order of their distance from the first one, so that neighbouring cells lie near each other
    place = np.empty(len(chosen), dtype="int64")
    place[np.argsort(_apart(sample[chosen], sample[:1], metric)[0][:, 0], kind="stable")] = np.arange(len(chosen))
    # an upper pivot is the first of its own
    order = np.lexsort((nearest_one[members], np.arange(len(members)) >= len(chosen), place[upper[members]]))
    members = members[order]
    begin = np.searchsorted(place[upper[members]], np.arange(len(chosen) + 1))
    return sample[members], begin


def _assigner(cover, metric: str):
    """Cell of every vector, and its distance from the pivot at most: a near pivot, not always the nearest."""

    def assign(batches):
        pivots, begin = cover.value
        uppers = pivots[begin[:-1]]
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack(batch["_vector"]).astype("float64")
            cell, reach = np.zeros(len(rows), dtype="int64"), np.full(len(rows), np.inf)
            step = max(1, _CHUNK_CELLS // len(uppers))
            for start in range(0, len(rows), step):
                part = np.arange(start, min(start + step, len(rows)))
                d, _ = _apart(rows[part], uppers, metric)
                tried = np.argpartition(d, min(_TRIED, d.shape[1]) - 1, axis=1)[:, :_TRIED]
                for u in np.unique(tried):
                    own = part[(tried == u).any(axis=1)]
                    below, lost = _apart(rows[own], pivots[begin[u]: begin[u + 1]], metric)
                    best = below.argmin(axis=1)
                    far = below[np.arange(len(own)), best] + lost
                    nearer = far < reach[own]
                    reach[own[nearer]], cell[own[nearer]] = far[nearer], begin[u] + best[nearer]
            yield batch.assign(_cell=cell, _reach=reach)

    return assign


def _asker(cover, k: int, metric: str, name: str):
    """For every query of a block the item blocks that can hold one of its results."""

    def ask(queries: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        pivots, _ = cover.value
        cells = cells.sort_values("_first", kind="stable")
        cell, size, reach = cells["_cell"].to_numpy(), cells["_n"].to_numpy(), cells["_reach"].to_numpy()
        first = cells["_first"].to_numpy()
        blocks = [np.zeros(0, dtype="int64")] * len(queries)
        if len(queries) and len(cells):
            rows = np.stack(queries["_vector"]).astype("float64")
            # the cells that share their first block stand together
            heads = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            # a cell of many items has several blocks of its own
            spans = np.maximum.reduceat(cells["_parts"].to_numpy(), heads)
            step = max(1, _CHUNK_CELLS // len(cells))
            for start in range(0, len(rows), step):
                d, lost = _apart(rows[start: start + step], pivots[cell], metric)
                lost = lost[:, None]
                # all items of a cell lie within its bound; one with more than k of them bounds the k-th result
                enough = np.where(size > k, d + lost + reach, np.inf).min(axis=1, keepdims=True)
                hit = np.logical_or.reduceat(d - lost - reach <= enough * (1 + 1e-12), heads, axis=1)
                for n, row in enumerate(hit):
                    found = [np.arange(first[heads[h]], first[heads[h]] + spans[h]) for h in np.flatnonzero(row)]
                    blocks[start + n] = np.unique(np.concatenate(found))
        return queries[["_g", name, "_vector", "_query"]].assign(_blocks=blocks)

    return ask


def _blocks(celled: DataFrame, rows: int) -> DataFrame:
    """Blocks of about ``rows`` vectors per cell: neighbouring cells share one, a large cell has several."""
    # one row per group and cell
    sizes = celled.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.max("_reach").alias("_reach"))
    before = W.partitionBy("_g").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    first = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows).cast("long")
    return sizes.withColumn("_first", first).withColumn("_parts", F.ceil(F.col("_n") / rows).cast("long"))


def _placed(celled: DataFrame, blocks: DataFrame, name: str, block: str) -> DataFrame:
    part = F.pmod(F.xxhash64(name), F.col("_parts"))
    return celled.drop("_reach").join(blocks.select("_g", "_cell", "_first", "_parts"), ["_g", "_cell"]).select(
        "_g", name, "_vector", (F.col("_first") + part).alias(block)
    )


# ---- search ----------------------------------------------------------------


def _useful_copies(items: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Items without the copies that can never be a result.

    Equal vectors tie and the smaller id wins, so of any number of copies only
    the first ``k`` count, and one more for a query that is a copy itself.
    Spark cuts the groups to that size before the shuffle.
    """
    same = W.partitionBy(*by, "_vector").orderBy("item_id")
    return items.withColumn("_copy", F.row_number().over(same)).filter(F.col("_copy") <= k + 1).drop("_copy")


def _top(pairs: DataFrame, k: int, by: list[str]) -> DataFrame:
    ranked = W.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), "item_id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    id_column: str = "id",
    vector: str = "vector",
    by: list[str] = (),
    metric: str = "cosine",
    block_rows: int | None = None,
    cells: int | None = None,
) -> DataFrame:
    """The ``k`` nearest items of every query, itself excluded, ranked from 1.

    ``cosine`` ranks by absolute cosine similarity, ``euclid`` by distance (the
    score is then the negative distance).  Scores are compared in full; ties go
    to the smaller item id.  ``block_rows`` and ``cells`` follow the number of
    items unless they are given; the result does not depend on them.

    The pivots are broadcast: twice the root of the items in number, and 8 MB
    at most; the driver chooses them from a sample of eight times that size.
    """
    by, spark = list(by), items.sparkSession
    right = items.select(*by, F.col(id_column).alias("item_id"), F.col(vector).alias("_vector"))
    right = freeze(_useful_copies(right, k, by))
    left = queries.select(*by, F.col(id_column).alias("query_id"), F.col(vector).alias("_vector"))
    # a number for every group, so that missing values need no care below
    groups = right.select(*by).distinct() if by else spark.range(1).select()
    groups = freeze(groups.withColumn("_g", F.monotonically_increasing_id()))
    left = null_safe_join(left, groups, by).drop(*by)
    right = null_safe_join(right, groups, by).drop(*by)
    count = right.count()
    rows = block_rows or min(MOST_BLOCK, max(LEAST_BLOCK, int(20 * math.sqrt(count))))
    width = right.agg(F.max(F.size("_vector"))).first()[0] or 1
    wanted = cells or max(1, min(int(2 * math.sqrt(count)), PIVOT_BYTES // (8 * width)))
    picked = right.orderBy(F.xxhash64("item_id"), "item_id", "_g").limit(SAMPLE * wanted).select("_vector").collect()
    schema = StructType(
        [
            StructField("_g", LongType()),
            StructField("query_id", left.schema["query_id"].dataType),
            StructField("item_id", right.schema["item_id"].dataType),
            StructField("score", DoubleType()),
        ]
    )
    if not picked:
        return _top(null_safe_join(spark.createDataFrame([], schema).drop("_g"), groups, []).select(
            *by, "query_id", "item_id", "score"), k, by)
    shared = spark.sparkContext.broadcast(_cover(np.array([r[0] for r in picked], dtype="float64"), wanted, metric))

    def celled(side: DataFrame) -> DataFrame:
        added = StructType(side.schema.fields + [StructField("_cell", LongType()), StructField("_reach", DoubleType())])
        return freeze(side.mapInPandas(_assigner(shared, metric), added))

    left, right = celled(left), celled(right)
    left_blocks, right_blocks = freeze(_blocks(left, rows)), freeze(_blocks(right, rows))
    asking = _placed(left, left_blocks, "query_id", "_query")
    # the cells of a group, once for each of its query blocks
    last = F.col("_first") + F.col("_parts") - 1
    query_blocks = left_blocks.select("_g", F.explode(F.sequence(F.col("_first"), last)).alias("_query")).distinct()
    asked = StructType(
        [*asking.schema.fields, StructField("_blocks", ArrayType(LongType()))]
    )
    sent = freeze(
        asking.groupBy("_g", "_query").cogroup(right_blocks.join(query_blocks, "_g").groupBy("_g", "_query"))
        .applyInPandas(_asker(shared, k, metric, "query_id"), asked)
    ).withColumn("_item", F.explode("_blocks")).drop("_blocks")
    block_pairs = freeze(sent.select("_g", "_query", "_item").distinct())
    keys = ["_g", "_query", "_item"]
    held = _placed(right, right_blocks, "item_id", "_item").join(block_pairs, ["_g", "_item"])

    def match(key: tuple, q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        found = _best_pairs(q, i, k, metric)
        found.insert(0, "_g", key[0])
        return found

    pairs = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(match, schema)
    named = pairs.join(groups, "_g").select(*by, "query_id", "item_id", "score")
    return _top(named, k, by)


def neighbour_vote(neighbours: DataFrame, labels: DataFrame, id_column: str = "id", label: str = "label") -> DataFrame:
    """Class with the highest sum of inverse distances; the smallest class on a tie.

    Neighbours at distance zero outvote all others.
    """
    distance = -F.col("score")
    voters = neighbours.join(labels.select(F.col(id_column).alias("item_id"), F.col(label).alias("_label")), "item_id")
    votes = voters.groupBy("query_id", "_label").agg(
        F.count_if(distance == 0).alias("_exact"),
        F.coalesce(F.sum(F.when(distance > 0, 1 / distance)), F.lit(0.0)).alias("_vote"),
    )
    # any exact match ranks above every vote without one
    best = F.max_by("_label", F.struct("_exact", "_vote", -F.col("_label")))
    return votes.groupBy("query_id").agg(best.alias("prediction"))
