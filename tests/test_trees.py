"""Forests against trees grown by plain recursion."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import sampling, trees

NAMES = ["x", "y", "flag", "same"]


def _data(n, models=(1,), seed=2):
    rnd = random.Random(seed)
    out = []
    for m in models:
        for i in range(n):
            x, y, flag = rnd.randrange(12) / 2, rnd.gauss(0, 1), float(rnd.random() < 0.3)
            label = int(x > 3) + int(y > 0.4 and flag > 0) if rnd.random() < 0.85 else rnd.randrange(3)
            out.append((m, f"k{i}", label, x, None if rnd.random() < 0.05 else y, flag, 1.0))
    return out


def _frame(spark, data):
    return spark.createDataFrame(data, "model int, key string, label int, x double, y double, flag double, same double")


def _impurity(labels, rule):
    n = len(labels)
    shares = [labels.count(k) / n for k in range(rule.classes)]
    groups = [[p, 1 - p] for p in shares] if rule.indicators else [shares]

    def one(ps):
        return 1 - sum(p * p for p in ps) if rule.criterion == "gini" else -sum(p * math.log2(p) for p in ps if p)

    return sum(one(ps) for ps in groups) / len(groups)


def _brute(train, asked, cuts, rule, tree=0, path=""):
    """Shares per asked row of one tree without bootstrap, by trying every bound of every looked-at feature."""
    labels = [t[0] for t in train]
    best = None
    if len(train) >= rule.min_split and len(set(labels)) > 1 and (rule.max_depth is None or len(path) < rule.max_depth):
        varied = [f for f in range(len(cuts)) if len({t[1][f] for t in train}) > 1]
        order = [f for f in trees.drawn_order(tree, path, len(cuts), rule.seed) if f in varied]
        for f in sorted(order[: rule.max_features]):
            for b in range(rule.bins):
                left = [t for t in train if t[1][f] <= b]
                right = [t for t in train if t[1][f] > b]
                if left and right:
                    parts = sum(len(p) * _impurity([t[0] for t in p], rule) for p in (left, right))
                    gain = len(train) * _impurity(labels, rule) - parts
                    if best is None or gain > best[0] + 1e-9 * len(train):
                        best = (gain, f, b)
    if best is None:
        return {k: [labels.count(c) / len(labels) for c in range(rule.classes)] for k, _ in asked}
    _, f, b = best
    out = {}
    for side, goes in (("L", lambda v: v[f] <= b), ("R", lambda v: v[f] > b)):
        out |= _brute([t for t in train if goes(t[1])], [a for a in asked if goes(a[1])], cuts, rule, tree, path + side)
    return out


RULES = [
    trees.Rule(3, max_features=4, min_split=2, trees=1, bins=16, bootstrap=False),
    trees.Rule(3, criterion="gini", max_features=2, min_split=20, trees=1, bins=8, bootstrap=False),
    trees.Rule(3, max_features=2, min_split=3, max_depth=3, trees=2, bins=16, bootstrap=False, indicators=True),
]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("local_rows", [60, 200_000])
def test_trees_equal_plain_recursion(spark, rule, local_rows):
    data = _data(160, (1, 7))
    df = _frame(spark, data)
    got, _ = trees.fit_predict(df, df.drop("label"), NAMES, rule, local_rows)
    got = {(r["model"], r["key"]): r["shares"] for r in got.collect()}
    cuts = trees.bounds(df, NAMES, rule.bins)
    for m in (1, 7):
        own = [
            (d[2], tuple(int(np.searchsorted(e, -math.inf if v is None else v)) for e, v in zip(cuts, d[3:])), d[1])
            for d in data if d[0] == m
        ]
        want = [
            _brute([(label, b) for label, b, _ in own], [(k, b) for _, b, k in own], cuts, rule, t) for t in range(rule.trees)
        ]
        for _, _, k in own:
            assert got[m, k] == pytest.approx(np.mean([w[k] for w in want], axis=0))


def test_models_together_equal_models_alone(spark):
    df = _frame(spark, _data(120, (1, 2, 3)))
    rule = trees.Rule(3, trees=4)
    together, weights = trees.fit_predict(df, df.drop("label"), NAMES, rule, 100)
    # the bounds come from all rows, so the models are compared by the same rows
    again, same = trees.fit_predict(df.repartition(3), df.drop("label"), NAMES, rule)
    assert rows(together) == rows(again)
    for got, want in zip(rows(weights), rows(same)):
        assert got[:2] == want[:2] and got[2] == pytest.approx(want[2])
    totals = weights.groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert len(totals) == 3 and all(r["s"] == pytest.approx(1) for r in totals)
    used = {(r["model"], r["feature"]): r["importance"] for r in weights.collect()}
    assert used[1, "same"] == 0 and used[1, "x"] > used[1, "flag"]


def test_split_limit_acts_on_splits(spark):
    df = _frame(spark, [(1, f"k{i}", i % 2, float(i), 0.0, 0.0, 0.0) for i in range(9)])
    rule = trees.Rule(2, min_split=9, trees=1, bins=64, bootstrap=False)
    leaves, _ = trees.fit_predict(df, df.drop("label"), NAMES, rule)
    # the root is split, no child is
    assert len({tuple(r["shares"]) for r in leaves.collect()}) == 2
    whole, _ = trees.fit_predict(df, df.drop("label"), NAMES, trees.Rule(2, min_split=2, trees=1, bins=64, bootstrap=False))
    assert all(max(r["shares"]) == 1 for r in whole.collect())


def test_forest_without_rows(spark):
    df = _frame(spark, _data(5))
    none = df.limit(0)
    shares, weights = trees.fit_predict(none, df.drop("label"), NAMES, trees.Rule(3))
    assert shares.count() == 0 and weights.count() == 0
    shares, _ = trees.fit_predict(df, none.drop("label"), NAMES, trees.Rule(3))
    assert shares.count() == 0


def test_bootstrap_draws_about_one_copy_a_row(spark):
    df = spark.range(4000).select(F.lit(1).alias("model"), F.col("id").cast("string").alias("key"), F.lit(0).alias("tree"))
    drawn = Counter(r[0] for r in df.select(trees._copies(trees.Rule(2))).collect())
    assert abs(sum(k * n for k, n in drawn.items()) / 4000 - 1) < 0.06 and abs(drawn[0] / 4000 - math.exp(-1)) < 0.03


def test_draws_within_groups_equal_draws_of_each_group(spark):
    data = [(g, k, f"{g}{k}{i}") for g, sizes in {"a": (4, 40, 90), "b": (30, 1, 12), "c": (0, 5, 8)}.items() for k in range(3) for i in range(sizes[k])]
    df = spark.createDataFrame(data, "g string, label int, id string")
    got = sampling.upsample_within(df, ["g"], "label", "id", 2, [0, 1])
    for g in "abc":
        want = sampling.upsample(df.filter(F.col("g") == g), "label", "id", 2, [0, 1])
        assert rows(got.filter(F.col("g") == g), "label", "id", "draw") == rows(want, "label", "id", "draw")


def test_equal_rows_travel_once_for_all_trees(spark, monkeypatch):
    distinct = _data(30)
    copies = [(m, f"{key}#{i}", *rest) for m, key, *rest in distinct for i in range(20)]
    written = []
    monkeypatch.setattr(trees, "freeze", lambda df: written.append(df.localCheckpoint()) or written[-1])
    asked = _frame(spark, distinct).drop("label")
    shares, _ = trees.fit_predict(_frame(spark, copies), asked, NAMES, trees.Rule(3, trees=6))
    assert shares.count() == 30
    # neither copies nor trees multiply what is written and dealt to the tasks
    assert written[0].count() <= 60


def test_nodes_grown_together_equal_nodes_alone():
    rnd = np.random.default_rng(4)
    bins, labels = rnd.integers(0, 6, (300, 5)).astype(np.int8), rnd.integers(0, 3, 300)
    weights, counts = rnd.integers(0, 4, 300).astype(float), np.ones(300, dtype=np.int64)
    rule = trees.Rule(3, max_features=2, min_split=4, bins=6)
    got, gains = trees.grow(bins, labels, weights, counts, bins, 3, "LR", rule)
    want, total, stack = np.zeros((300, 3)), np.zeros(5), [("LR", np.arange(300))]
    while stack:
        path, at = stack.pop()
        taught = at[weights[at] > 0]
        cells = trees._counts(bins[taught], labels[taught], weights[taught], rule)
        split = trees.best_split(cells, len(taught), 3, path, rule)
        if split is None:
            want[at] = cells[0].sum(axis=0) / cells[0].sum()
            continue
        total[split[0]] += split[2]
        left = bins[at, split[0]] <= split[1]
        stack += [(path + "L", at[left]), (path + "R", at[~left])]
    assert got == pytest.approx(want) and gains == pytest.approx(total)
