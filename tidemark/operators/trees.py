"""Random forests of many models at once, grown by node.

Training rows of equal label and bins are one row, with its weight and its number of rows in every tree.  Every row of a
model stands at one node of each tree.  Nodes with many rows are split level by level: one aggregate counts the binned
feature values of all such nodes of all trees of all models, and rows move on to the children.  Nodes with few rows are
grown to their leaves inside one task each, all nodes of a level in the same numpy calls; a small model goes to a task
once for several trees.  All ways follow the same rule, so the number of jobs grows with the logarithm of the largest
model only, not with models, trees or depth, and the limit between them changes nothing.

Rows to be scored travel with the training rows at weight 0 and take the shares of the leaf they end at; no tree has to
be held anywhere.

The rule: a node is split if it is impure, holds at least ``min_split`` training rows and lies above ``max_depth``.  Of
the features in the node's random order, the first ``max_features`` that vary inside the node are looked at; the split of
the greatest decrease wins, of equal ones the one of the lowest feature and bin.  Features are cut into ``bins`` parts by
their quantiles over all rows, so splits lie on those bounds.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 56
# rows, scored ones included, up to which a node is grown inside a task
LOCAL_ROWS = 200_000
# shares of 0, 1, 2 ... copies of a row in a bootstrap sample (Poisson with mean 1), added up
COPIES = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
NODE = ["model", "tree", "path"]
GROWN = "model long, key string, leaves array<struct<tree: int, shares: array<double>>>, tree int, feature int, gain double"
# groups into which the trees of small models are dealt, at least
TASKS = 200
# counts that a task holds at once
CELLS = 500_000


@dataclass(frozen=True)
class Rule:
    classes: int
    criterion: str = "entropy"
    max_features: int = 4
    min_split: int = 3
    max_depth: int | None = None
    trees: int = 10
    bins: int = 32
    bootstrap: bool = True
    # one yes-or-no output per class, whose impurities are averaged, instead of one output of many classes
    indicators: bool = False
    seed: int = SEED


def bounds(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending distinct quantiles of every feature."""
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, F.lit(1000)).alias(f"_{i}") for i, c in enumerate(features)])
    return [np.unique(np.array(found or [], dtype=np.float64)) for found in row.first()]


def impurity(weights: np.ndarray, rule: Rule) -> np.ndarray:
    """Impurity of class weights (..., classes); 0 without weight."""
    total = weights.sum(axis=-1, keepdims=True)
    share = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
    if rule.indicators:
        share = np.stack([share, np.where(total > 0, 1 - share, 0.0)], axis=-1)
    if rule.criterion == "gini":
        found = np.where(share.sum(axis=-1) > 0, 1 - (share**2).sum(axis=-1), 0.0)
    else:
        found = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(axis=-1)
    return found.mean(axis=-1) if rule.indicators else found


def drawn_order(tree: int, path: str, features: int, seed: int) -> list[int]:
    """The node's random order of the features."""
    return sorted(range(features), key=lambda f: (zlib.crc32(f"{seed}:{tree}:{path}:{f}".encode()), f))


def best_split(counts: np.ndarray, rows: int, tree: int, path: str, rule: Rule) -> tuple[int, int, float] | None:
    """(feature, last bin of the left side, weighted decrease) of a node with these weights (feature, bin, class)."""
    total = counts[0].sum(axis=0)
    if rows < rule.min_split or (total > 0).sum() < 2 or (rule.max_depth is not None and len(path) >= rule.max_depth):
        return None
    varies = (counts.sum(axis=2) > 0).sum(axis=1) > 1
    if not varies.any():
        return None
    looked = sorted([f for f in drawn_order(tree, path, len(counts), rule.seed) if varies[f]][: rule.max_features])
    left = counts[looked].cumsum(axis=1)
    right = total - left
    size, rest = left.sum(axis=2), right.sum(axis=2)
    whole = total.sum()
    gain = whole * impurity(total, rule) - size * impurity(left, rule) - rest * impurity(right, rule)
    gain = np.where((size > 0) & (rest > 0), gain, -np.inf)
    # equal but for rounding counts as equal
    at = int(np.argmax(gain >= gain.max() - 1e-9 * whole))
    f, b = divmod(at, gain.shape[1])
    return looked[f], b, max(0.0, float(gain[f, b]))


def _counts(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rule: Rule) -> np.ndarray:
    rows, features = bins.shape
    cell = (np.arange(features) * rule.bins + bins) * rule.classes + labels[:, None]
    found = np.bincount(cell.ravel(), np.repeat(weights, features), features * rule.bins * rule.classes)
    return found.reshape(features, rule.bins, rule.classes)


def _best_splits(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, node: np.ndarray, varies: np.ndarray, states: list[int], rule: Rule
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_split`` of many nodes at once: features, last bins of the left sides, weighted decreases.

    Rows come in the order of their nodes; ``states`` are the checksums of seed, tree and path of the nodes.
    """
    nodes, features = varies.shape
    names = [f":{f}".encode() for f in range(features)]
    order = np.array([[zlib.crc32(name, state) for name in names] for state in states], dtype=np.int64)
    order = np.argsort(np.where(varies, order, np.int64(1) << 40), axis=1, kind="stable")[:, : rule.max_features]
    # places without a feature look at a last column in which no row differs
    looked = np.sort(np.where(np.take_along_axis(varies, order, axis=1), order, features), axis=1)
    places = looked.shape[1]
    held = np.take_along_axis(np.pad(bins, ((0, 0), (0, 1))), looked[node], axis=1).astype(np.int64)
    cell = ((node[:, None] * places + np.arange(places)) * rule.bins + held) * rule.classes + labels[:, None]
    counts = np.bincount(cell.ravel(), np.repeat(weights, places), nodes * places * rule.bins * rule.classes)
    counts = counts.reshape(nodes, places, rule.bins, rule.classes)
    total = counts[:, 0].sum(axis=1)
    left = counts.cumsum(axis=2)
    right = total[:, None, None] - left
    size, rest, whole = left.sum(axis=3), right.sum(axis=3), total.sum(axis=1)
    gain = (whole * impurity(total, rule))[:, None, None] - size * impurity(left, rule) - rest * impurity(right, rule)
    gain = np.where((size > 0) & (rest > 0), gain, -np.inf).reshape(nodes, -1)
    at = np.argmax(gain >= (gain.max(axis=1) - 1e-9 * whole)[:, None], axis=1)
    every = np.arange(nodes)
    return looked[every, at // rule.bins], at % rule.bins, np.maximum(0.0, gain[every, at])


def grow(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, counts: np.ndarray, asked: np.ndarray, tree: int, path: str, rule: Rule
) -> tuple[np.ndarray, np.ndarray]:
    """(leaf shares per row of ``asked``, decreases per feature) of the subtree at ``path``, grown level by level.

    A row stands for ``counts`` equal training rows of ``weights`` in all; rows of weight 0 do not teach.
    """
    shares, gains = np.full((len(asked), rule.classes), np.nan), np.zeros(bins.shape[1])
    rows = np.flatnonzero(weights > 0)
    node, place = np.zeros(len(rows), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
    waiting = np.arange(len(asked))
    states, depth = [zlib.crc32(f"{rule.seed}:{tree}:{path}".encode())], len(path)
    step = max(1, CELLS // (min(rule.max_features, bins.shape[1]) * rule.bins * rule.classes))
    while len(rows):
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        starts = np.searchsorted(node, np.arange(len(states)))
        total = np.bincount(node * rule.classes + labels[rows], weights[rows], len(states) * rule.classes).reshape(-1, rule.classes)
        own = bins[rows]
        varies = np.maximum.reduceat(own, starts) > np.minimum.reduceat(own, starts)
        splits = (np.add.reduceat(counts[rows], starts) >= rule.min_split) & ((total > 0).sum(axis=1) > 1) & varies.any(axis=1)
        if rule.max_depth is not None and depth >= rule.max_depth:
            splits[:] = False
        ended = ~splits[place]
        shares[waiting[ended]] = (total / total.sum(axis=1, keepdims=True))[place[ended]]
        waiting, place = waiting[~ended], place[~ended]
        goes_on = splits[node]
        number = np.cumsum(splits) - 1
        rows, own, node, place = rows[goes_on], own[goes_on], number[node[goes_on]], number[place]
        states = [state for state, s in zip(states, splits) if s]
        varies = varies[splits]
        feature, last = np.zeros(len(states), dtype=np.int64), np.zeros(len(states), dtype=np.int64)
        for first in range(0, len(states), step):
            part = slice(first, first + step)
            of = slice(*np.searchsorted(node, [first, first + step]))
            feature[part], last[part], gain = _best_splits(
                own[of], labels[rows[of]], weights[rows[of]], node[of] - first, varies[part], states[part], rule
            )
            np.add.at(gains, feature[part], gain)
        node = 2 * node + (bins[rows, feature[node]] > last[node])
        place = 2 * place + (asked[waiting, feature[place]] > last[place])
        states = [zlib.crc32(side, state) for state in states for side in (b"L", b"R")]
        depth += 1
    return shares, gains


def _lists(column) -> np.ndarray:
    """Lists of one length as a matrix."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def _grown(rule: Rule):
    """Leaves and decreases of all trees that a group holds; its first tree is in its key, the others follow at ``stride``."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute

        model, first, stride, path = (value.as_py() for value in key)
        teaches = pa.compute.is_null(table["key"])
        taught, passing = table.filter(teaches), table.filter(pa.compute.invert(teaches))
        asked, weights = _lists(passing["bins"]), _lists(table["weights"])[teaches.to_numpy()]
        found, decreases = [], []
        if len(taught):
            bins, counts, labels = _lists(taught["bins"]), _lists(taught["counts"]), taught["label"].to_numpy().astype(np.int64)
            asked = asked.reshape(len(passing), bins.shape[1])
            for i in range(weights.shape[1]):
                tree = first + i * stride
                shares, gains = grow(bins, labels, weights[:, i].astype(np.float64), counts[:, i], asked, tree, path, rule)
                if len(shares) and not np.isnan(shares[0, 0]):
                    found.append((tree, shares))
                decreases += [(tree, int(f), float(gains[f])) for f in np.flatnonzero(gains)]
        # per asked row its leaf in every tree
        votes, every = len(found) * len(passing), len(passing) if found else 0
        trees = pa.array(np.tile(np.array([t for t, _ in found], dtype=np.int32), every))
        leaves = np.stack([s for _, s in found], axis=1).ravel() if every else np.zeros(0)
        leaves = pa.ListArray.from_arrays(np.arange(0, leaves.size + 1, rule.classes, dtype=np.int32), pa.array(leaves))
        leaves = pa.StructArray.from_arrays([trees, leaves], ["tree", "shares"])
        leaves = pa.ListArray.from_arrays(np.arange(0, votes + 1, max(1, len(found)), dtype=np.int32), leaves)
        keys = passing["key"].combine_chunks().cast(pa.string())[:every]
        n = len(decreases)
        columns = [
            pa.array(np.full(every + n, model, dtype=np.int64)),
            pa.concat_arrays([keys, pa.nulls(n, pa.string())]),
            pa.concat_arrays([leaves, pa.nulls(n, leaves.type)]),
            *[
                pa.concat_arrays([pa.nulls(every, kind), pa.array([d[i] for d in decreases], kind)])
                for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))
            ],
        ]
        return pa.Table.from_arrays(columns, names=["model", "key", "leaves", "tree", "feature", "gain"])

    return run


def _node_counts(rule: Rule, features: int):
    """Per task and node the summed weights (feature, bin, class) and the training rows."""

    def run(batches):
        import pyarrow as pa

        def told(held):
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()), pa.array([held[k][0].tobytes() for k in keys], pa.binary()),
                    pa.array([held[k][1] for k in keys], pa.int64()),
                ],
                names=["model", "tree", "path", "counts", "rows"],
            )

        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            model, tree, path = (batch.column(c).to_pylist() for c in ("model", "tree", "path"))
            codes = {}
            code = np.array([codes.setdefault(k, len(codes)) for k in zip(model, tree, path)])
            bins, labels, weights, counts = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("bins", "label", "weight", "n")
            )
            bins = np.stack(bins).astype(np.int64)
            for k, i in codes.items():
                mine = code == i
                found, rows = held.get(k, (0.0, 0))
                held[k] = found + _counts(bins[mine], labels[mine], weights[mine], rule), rows + int(counts[mine].sum())
            if len(held) * features * rule.bins * rule.classes > CELLS:
                yield told(held)
                held = {}
        if held:
            yield told(held)

    return run


def _splits(rule: Rule, features: int):
    """Per large node its split, or the shares of a leaf; from the counts of the tasks."""
    import pandas as pd

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        model, tree, path = key
        counts = sum(np.frombuffer(blob) for blob in frame["counts"]).reshape(features, rule.bins, rule.classes)
        split = best_split(counts, int(frame["rows"].sum()), int(tree), path, rule)
        total = counts[0].sum(axis=0)
        feature, last, gain = split or (None, None, None)
        return pd.DataFrame(
            {
                "model": [model], "tree": [tree], "path": [path], "feature": pd.array([feature], dtype="Int32"),
                "last": pd.array([last], dtype="Int32"), "gain": [np.nan if gain is None else gain],
                "shares": [None if split else total / total.sum()],
            }
        )

    return run


def _copies(rule: Rule, tree: Column | None = None) -> Column:
    if not rule.bootstrap:
        return F.lit(1)
    tree = F.col("tree") if tree is None else tree
    even = F.pmod(F.xxhash64("model", "key", tree, F.lit(rule.seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    out = F.lit(len(COPIES))
    for n in range(len(COPIES) - 1, -1, -1):
        out = F.when(even < COPIES[n], F.lit(n)).otherwise(out)
    return out


def _dealt(df: DataFrame, trees: int, lanes: int) -> DataFrame:
    """Rows once per lane, with the weights and counts of its trees: lane i has the trees i, i + lanes, ..."""

    def own(name: str, lane: int) -> Column:
        return F.array(*[F.col(name)[t] for t in range(lane, trees, lanes)]).alias(name)

    each = F.array(*[F.struct(F.lit(i).alias("tree"), own("weights", i), own("counts", i)) for i in range(lanes)])
    dealt = df.withColumn("_lane", F.explode(each)).select(
        "model", F.col("_lane.tree"), F.lit("").alias("path"), "key", "label", F.col("_lane.weights"), F.col("_lane.counts"), "bins"
    )
    return dealt.filter(F.col("key").isNotNull() | F.exists("weights", lambda w: w > 0))


def _binned(df: DataFrame, features: list[str], edges: list[np.ndarray]) -> DataFrame:
    """Rows with ``bins``: per feature the number of bounds below the value; NULL and NaN lie below all."""
    slim = df.select("model", "key", "label", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float("-inf"))).alias(f"_x{i}") for i, c in enumerate(features)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [np.searchsorted(e, batch.column(3 + i).to_numpy(zero_copy_only=False)) for i, e in enumerate(edges)]
            bins = np.stack(columns, axis=1).astype(np.int8)
            flat = pa.ListArray.from_arrays(np.arange(0, bins.size + 1, bins.shape[1], dtype=np.int32), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], flat], names=["model", "key", "label", "bins"])

    return slim.mapInArrow(run, "model long, key string, label int, bins array<tinyint>")


def fit_predict(
    train: DataFrame, asked: DataFrame, features: list[str], rule: Rule, local_rows: int = LOCAL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(shares, importances) of one forest per ``model``.

    ``train`` holds (model, key, label 0 to classes - 1, features), ``asked`` (model, key, features); keys are unique inside
    their model.  The first result has (model, key, shares): the mean over the trees of the class shares in the asked
    row's leaf; rows of a model without training rows are absent.  The second has (model, feature, importance), which
    adds up to 1 over the features of a model that has any split.
    """
    if not 1 < rule.bins <= 127:
        raise ValueError("bins must lie between 2 and 127")
    both = [F.col("model").cast("long").alias("model"), F.col("key").cast("string").alias("key")]
    names = [F.col(c) for c in features]
    taught = train.select(*both, F.col("label").cast("int").alias("label"), *names)
    edges = bounds(taught, features, rule.bins)
    every = range(rule.trees)
    drawn = _binned(taught, features, edges).select("model", "label", "bins", *[_copies(rule, F.lit(t)).alias(f"_{t}") for t in every])
    # rows that no split can tell apart count once
    samples = drawn.groupBy("model", "label", "bins").agg(
        F.array(*[F.sum(f"_{t}").cast("int") for t in every]).alias("weights"),
        F.array(*[F.count_if(F.col(f"_{t}") > 0).cast("int") for t in every]).alias("counts"),
    )
    passing = _binned(asked.select(*both, F.lit(0).alias("label"), *names), features, edges)
    zeros = F.array(*[F.lit(0) for _ in every])
    passing = passing.withColumn("weights", zeros).withColumn("counts", zeros)
    held = freeze(samples.withColumn("key", F.lit(None).cast("string")).unionByName(passing))
    # one row per model
    sizes = freeze(held.groupBy("model").agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.filter(F.col("_n") > local_rows).select("model")
    lanes = min(rule.trees, max(1, -(-TASKS // max(1, sizes.count()))))
    dealt = _dealt(held.join(large, "model", "left_anti"), rule.trees, lanes).withColumn("stride", F.lit(lanes))
    order = ["model", "tree", "path", "key", "label", "weights", "counts", "bins"]
    nodes = _dealt(held.join(large, "model", "left_semi"), rule.trees, rule.trees)
    small, leaves, gains = [dealt], [], []
    one = lambda df: df.withColumn("stride", F.lit(1))
    while not large.isEmpty():
        nodes = freeze(nodes.select(*order))
        large = freeze(nodes.groupBy(*NODE).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > local_rows).select(*NODE))
        if large.isEmpty():
            small.append(one(nodes))
            break
        small.append(one(nodes.join(large, NODE, "left_anti")))
        held = freeze(nodes.join(large, NODE, "left_semi"))
        taught = held.filter("key IS NULL").select(*NODE, "label", F.col("weights")[0].alias("weight"), F.col("counts")[0].alias("n"), "bins")
        counted = taught.mapInArrow(
            _node_counts(rule, len(features)), "model long, tree int, path string, counts binary, rows long"
        )
        found = freeze(
            counted.groupBy(*NODE).applyInPandas(
                _splits(rule, len(features)),
                "model long, tree int, path string, feature int, last int, gain double, shares array<double>",
            )
        )
        gains.append(found.filter("feature IS NOT NULL").select("model", "tree", "feature", "gain"))
        moved = held.join(found, NODE)
        ended = moved.filter("feature IS NULL AND key IS NOT NULL")
        leaves.append(ended.select("model", "key", F.array(F.struct("tree", "shares")).alias("leaves")))
        side = F.when(F.get("bins", F.col("feature")) <= F.col("last"), "L").otherwise("R")
        nodes = moved.filter("feature IS NOT NULL").withColumn("path", F.concat("path", side))
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    grown = freeze(rest.groupBy("model", "tree", "stride", "path").applyInArrow(_grown(rule), GROWN))
    leaves.append(grown.filter("key IS NOT NULL").select("model", "key", "leaves"))
    gains.append(grown.filter("feature IS NOT NULL").select("model", "tree", "feature", "gain"))
    ended, split = leaves[0], gains[0]
    for more, further in zip(leaves[1:], gains[1:]):
        ended, split = ended.unionByName(more), split.unionByName(further)
    # added up in the order of the trees, whichever tasks grew them
    ended = ended.groupBy("model", "key").agg(F.array_sort(F.flatten(F.collect_list("leaves"))).alias("leaves"))

    def share(k: int) -> Column:
        total = F.aggregate("leaves", F.lit(0.0), lambda done, leaf: done + F.get(leaf["shares"], F.lit(k)))
        return total / F.size("leaves")

    shares = ended.select("model", "key", F.array(*[share(k) for k in range(rule.classes)]).alias("shares"))
    return shares, _importances(split, features)


def _importances(split: DataFrame, features: list[str]) -> DataFrame:
    """Decreases as shares of their tree's, averaged over the trees that split; features never used have 0."""
    per_tree = split.groupBy("model", "tree", "feature").agg(F.sum("gain").alias("gain"))
    totals = per_tree.groupBy("model", "tree").agg(F.sum("gain").alias("total")).filter("total > 0")
    trees = totals.groupBy("model").agg(F.count(F.lit(1)).alias("trees"))
    used = per_tree.join(totals, ["model", "tree"]).groupBy("model", "feature").agg(F.sum(F.col("gain") / F.col("total")).alias("sum"))
    every = trees.select("model", "trees", F.posexplode(F.array(*[F.lit(c) for c in features])).alias("feature", "name"))
    return every.join(used, ["model", "feature"], "left").select(
        "model", F.col("name").alias("feature"), (F.coalesce("sum", F.lit(0.0)) / F.col("trees")).alias("importance")
    )


def with_class(shares: DataFrame, classes: int) -> DataFrame:
    """``pred``, the class of the greatest share (ties: the first), and one ``proba`` column per class."""
    top = F.array_position("shares", F.array_max("shares")) - 1
    return shares.select(
        "model", "key", top.cast("int").alias("pred"), *[F.get("shares", F.lit(k)).alias(f"proba{k}") for k in range(classes)]
    )
