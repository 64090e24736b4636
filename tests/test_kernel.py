"""Kernel classifier against the exact kernel solution."""

import numpy as np
import pytest

from tidemark.operators import kernel


def _rings(n, seed=1):
    x = np.random.RandomState(seed).randn(n, 2)
    far = (x**2).sum(axis=1) > 1.2
    return x, far.astype(int) + (far & (x[:, 0] > 0))


def _exact_scores(x, labels, classes, gamma, c):
    """One machine per class, solved on the kernel matrix with the rows that miss the margin."""
    gram, scores = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=-1)), []
    for k in classes:
        y, active = np.where(labels == k, 1.0, -1.0), np.ones(len(x), dtype=bool)
        for _ in range(100):
            at = np.flatnonzero(active)
            system = np.ones((len(at) + 1, len(at) + 1))
            system[:-1, :-1] = gram[np.ix_(at, at)] + np.eye(len(at)) / (2 * c)
            system[-1, -1] = 0
            solved = np.linalg.solve(system, np.append(y[at], 0))
            score = gram[:, at] @ solved[:-1] + solved[-1]
            if ((y * score < 1) == active).all():
                break
            active = y * score < 1
        scores.append(score)
    return np.array(scores).T


def _frame(spark, x, labels):
    rows = [(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, x double, y double, label int").repartition(3)


def test_predictions_equal_the_exact_kernel_machine(spark):
    x, labels = _rings(300)
    machines = kernel.fit(
        _frame(spark, x, labels), ["x", "y"], "label", [0, 1, 2], [{"c": 10.0, "gamma": 0.5}], cosines=kernel.draw_cosines(2, 800)
    )
    got = {r["id"]: r["pred"] for r in kernel.predict(_frame(spark, x, labels), ["x", "y"], machines, ["id"]).collect()}
    want = _exact_scores(x, labels, [0, 1, 2], 0.5, 10.0).argmax(axis=1)
    assert np.mean([got[i] == want[i] for i in range(len(x))]) >= 0.98
    assert np.mean([got[i] == labels[i] for i in range(len(x))]) >= 0.95


@pytest.mark.parametrize("count", [64, 1024])
def test_features_keep_the_stated_error(count):
    x, _ = _rings(200, 3)
    errors = []
    for seed in range(40):
        z = kernel.draw_cosines(2, count, seed).of(x, 0.7)[:, :-1]
        errors.append(((z @ z.T - np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(axis=-1))) ** 2).mean())
    assert np.sqrt(np.mean(errors)) <= 1 / np.sqrt(count)


def test_gradient_is_that_of_the_loss(spark):
    x, labels = _rings(50)
    draws = kernel.draw_cosines(2, 6)
    machines = kernel.Machines([{"c": 1.0, "gamma": 0.4}], [0, 1, 2], 2, draws, np.random.RandomState(0).randn(1, 2, 3, 7))
    rows = _frame(spark, x, labels).selectExpr("x", "y", "label", "cast(id % 2 as int) AS fold")
    along = np.zeros_like(machines.weights)
    along[..., 4] = 1.0
    found = kernel.losses(rows, ["x", "y"], "label", machines, along, (0.0, 1e-5))
    assert found[0, 1, :, :, 0] - found[0, 0, :, :, 0] == pytest.approx(1e-5 * found[0, 0, :, :, 5], rel=1e-3, abs=1e-8)
    # machines of a fold learn from the other fold only
    z, sign = draws.of(x[1::2], 0.4), np.where(labels[1::2, None] == np.arange(3), 1.0, -1.0)
    assert found[0, 0, 0, :, 0] == pytest.approx((np.maximum(0, 1 - sign * (z @ machines.weights[0, 0].T)) ** 2).sum(axis=0))


def test_search_prefers_a_width_that_fits(spark):
    x, labels = _rings(150)
    found = kernel.search(
        _frame(spark, x, labels), ["x", "y"], "id", [{"c": 10.0, "gamma": 1e-6}, {"c": 10.0, "gamma": 0.5}], steps=25
    ).collect()
    scores = {r["gamma"]: r["score"] for r in found}
    assert scores[0.5] > 0.85 > scores[1e-6]


def test_single_fit_without_rows(spark):
    none = _frame(spark, *_rings(3)).limit(0)
    machines = kernel.fit(none, ["x", "y"], "label", [0, 1], [{"c": 1.0, "gamma": 0.1}], steps=2)
    assert kernel.predict(none, ["x", "y"], machines, ["id"]).count() == 0


def test_resting_machines_cost_nothing(spark):
    draw = np.random.default_rng(8)
    data = [(float(a), float(b), int(a > 0), i % 2) for i, (a, b) in enumerate(draw.normal(size=(300, 2)))]
    rows = spark.createDataFrame(data, "x double, y double, label int, fold int").repartition(3)
    cosines = kernel.draw_cosines(2, 16)
    settings = [{"c": 1.0, "gamma": 0.2}, {"c": 2.0, "gamma": 0.7}, {"c": 3.0, "gamma": 1.5}]
    weights, along = draw.normal(size=(3, 2, 2, 17)), draw.normal(size=(3, 2, 2, 17))
    machines = kernel.Machines(settings, [0, 1], 2, cosines, weights)
    lengths = (1.0, 0.25)
    whole = kernel.losses(rows, ["x", "y"], "label", machines, along, lengths)
    x, label, fold = np.array([r[:2] for r in data]), np.array([r[2] for r in data]), np.array([r[3] for r in data])
    for c, i, f, j in np.ndindex(3, 2, 2, 2):
        z, sign = cosines.of(x[fold != f], settings[c]["gamma"]), np.where(label[fold != f] == j, 1.0, -1.0)
        lack = np.maximum(0, 1 - sign * (z @ (weights[c, f, j] + lengths[i] * along[c, f, j])))
        assert whole[c, i, f, j] == pytest.approx(np.r_[(lack**2).sum(), -2 * (lack * sign) @ z])
    resting = {(1, f, j) for f in range(2) for j in range(2)} | {(2, 0, 1)}
    some = kernel.losses(rows, ["x", "y"], "label", machines, along, lengths, resting)
    for k in np.ndindex(3, 2, 2):
        c, f, j = k
        assert some[c, :, f, j] == pytest.approx(whole[c, :, f, j] * (k not in resting))
