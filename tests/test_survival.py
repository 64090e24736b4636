import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import survival as op
from tidemark.plans import survival as plan


def _golden(spark):
    seed = spark.createDataFrame([("FB", True, 12, 0.0), ("SU", True, 10, 0.0)], "id string, E boolean, T int, funding double")
    changes = spark.createDataFrame(
        [("FB", 5, 30.0), ("FB", 10, 15.0), ("FB", 15, 50.0), ("SU", 6, 10.0), ("SU", 10, 9.0)],
        "id string, t int, funding double",
    )
    return op.long_format(seed, "T"), changes


@pytest.mark.parametrize("limit", [None, 1])
def test_covariate_intervals(spark, limit):
    base, changes = _golden(spark)
    both = op.add_covariates(
        op.add_covariates(base, changes, "id", "t", "E", cumulative=True, limit=limit), changes, "id", "t", "E", limit=limit
    )
    assert rows(both, "id", "start", "stop", "cumsum_funding", "funding", "E") == [
        ("FB", 0.0, 5.0, 0.0, 0.0, False),
        ("FB", 10.0, 12.0, 45.0, 15.0, True),
        ("FB", 5.0, 10.0, 30.0, 30.0, False),
        ("SU", 0.0, 6.0, 0.0, 0.0, False),
        ("SU", 10.0, 10.0, 19.0, 9.0, True),
        ("SU", 6.0, 10.0, 10.0, 10.0, False),
    ]


def test_repeated_change_times_are_added(spark):
    base = spark.createDataFrame([("a", 0.0, 9.0, True)], "id string, start double, stop double, E boolean")
    changes = spark.createDataFrame([("a", 3, 1.0), ("a", 3, 2.0), ("b", 1, 5.0)], "id string, t int, x double")
    assert rows(op.add_covariates(base, changes, "id", "t", "E"), "id", "start", "stop", "x", "E") == [
        ("a", 0.0, 3.0, 0.0, False), ("a", 3.0, 9.0, 3.0, True)
    ]


def test_stated_nulls_stay(spark):
    base = spark.createDataFrame(
        [("a", 0.0, 5.0, "x", False), ("a", 5.0, 9.0, None, True)], "id string, start double, stop double, kind string, E boolean"
    )
    changes = spark.createDataFrame([("a", -2, 1.0), ("a", 7, 2.0)], "id string, t int, v double")
    got = rows(op.add_covariates(base, changes, "id", "t", "E"), "start", "kind", "v")
    assert got == [(-2.0, "x", 1.0), (0.0, "x", 1.0), (5.0, None, 1.0), (7.0, None, 2.0)]


def test_event_rows(spark):
    base = spark.createDataFrame([(1, 1, None, 2), (2, None, 5, None), (3, 3, 5, 7)], "id int, E1 int, E2 int, E3 int")
    assert rows(op.event_rows(base, "id", ["E1", "E2", "E3"])) == [
        (1, 1, 1, 0, 0), (1, 2, 0, 0, 1), (2, 5, 0, 1, 0), (3, 3, 1, 0, 0), (3, 5, 0, 1, 0), (3, 7, 0, 0, 1)
    ]


def test_clean_intervals(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0), ("b", -1.0, 3.0), ("c", None, 4.0), ("d", 2.0, 2.0)], "id string, start double, stop double"
    )
    assert rows(op.clean_intervals(df)) == [("c", 0.0, 4.0), ("d", 2.0, 2.0)]


def _subjects(n=200, seed=3):
    draw = random.Random(seed)
    return [
        (i, float(draw.randint(1, 25)), draw.random() < 0.6, draw.choice(["a", "b", "c"]), draw.randint(0, 8) / 2, draw.gauss(0, 1))
        for i in range(n)
    ]


SCHEMA = "id int, t double, e boolean, g string, s double, x double"


@pytest.mark.parametrize("limit", [None, 5])
def test_kaplan_meier(spark, limit):
    data = _subjects()
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["t"]: r for r in op.kaplan_meier(df, "t", "e", limit=limit).collect()}
    survival, spread = 1.0, 0.0
    for t in sorted({r[1] for r in data}):
        n = sum(r[1] >= t for r in data)
        d = sum(r[1] == t and r[2] for r in data)
        survival *= 1 - d / n
        spread += d / (n * (n - d)) if n > d else 0
        assert (got[t]["n"], got[t]["d"]) == (n, d)
        assert got[t]["survival"] == pytest.approx(survival)
        assert got[t]["variance"] == pytest.approx(survival**2 * spread)
    assert got[0.0]["survival"] == 1.0
    curve = [got[t]["survival"] for t in sorted(got)]
    assert all(0 <= b <= a <= 1 for a, b in zip(curve, curve[1:]))
    quantiles = dict(rows(op.survival_quantiles(op.kaplan_meier(df, "t", "e", limit=limit), [0.25, 0.5]), "p", "t"))
    assert quantiles[0.5] == min(t for t in got if got[t]["survival"] <= 0.5)


@pytest.mark.parametrize("limit", [None, 5])
def test_nelson_aalen_smoothing(spark, limit):
    data = _subjects(400)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["t"]: r["hazard"] for r in op.nelson_aalen(df, "t", "e", limit=limit).collect()}
    hazard = 0.0
    for t in sorted({r[1] for r in data}):
        n = sum(r[1] >= t for r in data)
        d = sum(r[1] == t and r[2] for r in data)
        hazard += sum(1 / (n - i) for i in range(d))
        assert got[t] == pytest.approx(hazard, abs=1e-10)


def _brute_logrank(data, groups):
    observed, expected = np.zeros(len(groups)), np.zeros(len(groups))
    cov = np.zeros((len(groups), len(groups)))
    for t in sorted({r[1] for r in data if r[2]}):
        at = np.array([sum(r[1] >= t and r[3] == g for r in data) for g in groups], float)
        dead = np.array([sum(r[1] == t and r[2] and r[3] == g for r in data) for g in groups], float)
        n, d = at.sum(), dead.sum()
        observed += dead
        expected += d * at / n
        if n > 1:
            cov += d * (n - d) / (n - 1) * (np.diag(at / n) - np.outer(at / n, at / n))
    return observed, expected, cov


@pytest.mark.parametrize("limit", [None, 5])
def test_logrank(spark, limit):
    data, groups = _subjects(), ["a", "b", "c"]
    df = spark.createDataFrame(data, SCHEMA)
    observed, expected, cov = _brute_logrank(data, groups)
    got = {r["g"]: r for r in op.logrank(df, "t", "e", "g", groups, limit).collect()}
    for i, g in enumerate(groups):
        assert got[g]["observed"] == observed[i]
        assert got[g]["expected"] == pytest.approx(expected[i])
        assert got[g]["variance"] == pytest.approx(cov[i, i])
    chi, degrees, p = op.logrank_test(df, "t", "e", "g", groups, limit)
    z = (observed - expected)[:2]
    assert chi == pytest.approx(z @ np.linalg.solve(cov[:2, :2], z)) and degrees == 2
    assert p == pytest.approx(math.exp(-chi / 2))


def test_chi_square_tail():
    assert op.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert op.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert op.chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert op.chi_square_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert op.chi_square_tail(11.070497693516351, 5) == pytest.approx(0.05)


def _brute_cox(data, x, starts, ties):
    """Newton steps over an explicit list of risk sets."""
    t = np.array([r[1] for r in data])
    e = np.array([r[2] for r in data])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        g, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        for time in np.unique(t[e]):
            risk, dead = (t >= time) & (starts < time), (t == time) & e
            w = np.exp(x @ b)
            d = dead.sum()
            for k in range(d):
                f = k / d if ties == "efron" else 0.0
                weight = w * risk - f * w * dead
                s0, s1 = weight.sum(), weight @ x
                g += x[dead].sum(0) / d - s1 / s0
                h += (x.T * weight) @ x / s0 - np.outer(s1, s1) / s0**2
        b = b + np.linalg.solve(h, g)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.mark.parametrize("ties,with_start,limit", [("efron", False, None), ("breslow", True, None), ("efron", True, 7)])
def test_cox_against_brute_force(spark, ties, with_start, limit):
    data = _subjects(150)
    draw = random.Random(9)
    starts = np.array([float(draw.randint(0, int(r[1]) - 1)) if with_start else -1.0 for r in data])
    x = np.array([[r[4], r[5]] for r in data])
    coef, error = _brute_cox(data, x, starts, ties)
    df = spark.createDataFrame([(*r, float(s)) for r, s in zip(data, starts)], SCHEMA + ", start double")
    fit = op.cox_fit(df, ["s", "x"], "t", "e", start="start" if with_start else None, ties=ties, limit=limit)
    assert fit.coef == pytest.approx(coef, abs=1e-6)
    assert fit.error == pytest.approx(error, abs=1e-6)
    summary = {r["covariate"]: r for r in fit.summary(spark).collect()}
    assert summary["s"]["exp_coef"] == pytest.approx(math.exp(coef[0]), abs=1e-5)


def test_cox_spread_over_tasks(spark, monkeypatch):
    data = _subjects(120)
    df = spark.createDataFrame(data, SCHEMA)
    plain = op.cox_fit(df, ["s", "x"], "t", "e")
    monkeypatch.setattr(op, "_TIES_PER_ROW", 2)
    assert op.cox_fit(df, ["s", "x"], "t", "e").coef == pytest.approx(plain.coef, abs=1e-9)


def test_folds_are_fitted_and_scored_together(spark, monkeypatch):
    data = [(f"{i}", *r[1:]) for i, r in enumerate(_subjects(160))]
    df = spark.createDataFrame(data, "id string, " + SCHEMA.split(", ", 1)[1])
    step, calls = op._cox_step, []
    monkeypatch.setattr(op, "_cox_step", lambda *a, **b: calls.append(1) or step(*a, **b))
    got = {r["fold"]: r for r in plan.kfold_concordance(df, ["s", "x"], "t", "e", "id", k=4).collect()}
    together = len(calls)
    folded = plan.folds(df, "e", "id", 4).cache()
    most = 0
    for fold in range(4):
        calls.clear()
        fit = op.cox_fit(folded.filter(F.col("fold") != fold), ["s", "x"], "t", "e")
        most = max(most, len(calls))
        held = folded.filter(F.col("fold") == fold).withColumn("score", -fit.risk())
        want = op.concordance(held, "t", "e", "score").first()
        assert [got[fold][c] for c in ("comparable", "concordant", "tied")] == [want[c] for c in ("comparable", "concordant", "tied")]
    # the folds take their steps together: as many as the slowest of them
    assert together <= most + 1


def test_hopeless_fit_says_so(spark):
    data = [(float(i), i % 2 == 0, 1.0 * (i % 3), 2.0 * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(data, "t double, e boolean, a double, b double")
    assert not op.cox_fit(df, ["a", "b"], "t", "e").converged
    apart = spark.createDataFrame([(float(i), i < 10, float(i < 10)) for i in range(30)], "t double, e boolean, x double")
    assert not op.cox_fit(apart, ["x"], "t", "e", steps=6).converged


def test_additive_hazard_without_covariates_is_nelson_aalen(spark):
    df = spark.createDataFrame(_subjects(80), SCHEMA)
    want = {r["t"]: r["hazard"] for r in op.nelson_aalen(df, "t", "e", smoothing=False).collect()}
    got = op.additive_hazard(df, [], "t", "e").collect()
    assert got and all(r["baseline"] == pytest.approx(want[r["t"]]) for r in got)


@pytest.mark.parametrize("intercept", [True, False])
def test_additive_survival_equals_plain_sums(spark, intercept, monkeypatch):
    import math

    import numpy as np

    rows_in = [(float(1 + i % 9), i % 3 != 0, 1.0 + (i * 7) % 5, 0.5 * ((i * 3) % 4)) for i in range(60)]
    df = spark.createDataFrame(rows_in, "t double, e boolean, a double, b double")
    fitted = op.additive_hazard(df, ["a", "b"], "t", "e", intercept=intercept)
    assert fitted.columns == ["t", *["baseline"] * intercept, "a", "b"]
    subjects = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.0, 0.0), (3, None, 1.0)], "k int, a double, b double")
    monkeypatch.setattr(op._every_time, "__defaults__", (4,))
    got = {(r.k, r.t): r.survival for r in op.additive_survival(fitted, subjects, ["a", "b"], "k").collect()}
    x = np.array([[1.0] * intercept + [a, b] for _, _, a, b in rows_in])
    times, died = np.array([r[0] for r in rows_in]), np.array([r[1] for r in rows_in])
    total, want = np.zeros(x.shape[1]), {}
    for t in sorted(set(times[died])):
        risk = x[times >= t]
        m = risk.T @ risk
        if np.linalg.det(m) > 1e-6 * np.prod(np.diag(m)):
            total = total + np.linalg.solve(m, x[(times == t) & died].sum(axis=0))
        for k, a, b in ((1, 0.1, 0.2), (2, 0.0, 0.0)):
            want[k, t] = math.exp(-float(total @ np.array([1.0] * intercept + [a, b])))
        want[3, t] = None
    assert got.keys() == want.keys() and len(got) > 3 * 4
    assert all(got[at] is None if value is None else got[at] == pytest.approx(value) for at, value in want.items())
    assert op.additive_survival(fitted.limit(0), subjects, ["a", "b"], "k").count() == 0


def test_additive_model_without_terms_is_refused(spark):
    with pytest.raises(ValueError):
        op.additive_hazard(spark.createDataFrame(_subjects(9), SCHEMA), [], "t", "e", intercept=False)


def test_baseline_without_effect_is_breslow(spark):
    df = spark.createDataFrame(_subjects(80), SCHEMA)
    fit = op.cox_fit(df, ["s"], "t", "e")
    fit.coef = fit.coef * 0
    base = op.baseline_hazard(df, fit, "t", "e")
    want = {r["t"]: r["hazard"] for r in op.nelson_aalen(df, "t", "e", smoothing=False).collect()}
    assert all(r["hazard"] == pytest.approx(want[r["t"]]) for r in base.collect())
    curves = op.subject_curves(base, df.limit(2).withColumn("k", F.monotonically_increasing_id()), fit, "k")
    assert curves.count() == 2 * base.count()


def _brute_concordance(data):
    comparable = concordant = tied = 0
    for a in data:
        for b in data:
            if a[2] and (b[1] > a[1] or (b[1] == a[1] and not b[2])):
                comparable += 1
                concordant += b[4] > a[4]
                tied += b[4] == a[4]
    return comparable, concordant, tied


@pytest.mark.parametrize("limit", [None, 20])
def test_concordance(spark, limit):
    data = _subjects(150)
    df = spark.createDataFrame(data, SCHEMA)
    got = op.concordance(df, "t", "e", "s", limit=limit).first()
    want = _brute_concordance(data)
    assert (got.comparable, got.concordant, got.tied) == want
    assert got["concordance"] == pytest.approx((want[1] + want[2] / 2) / want[0])


def test_concordance_per_group(spark):
    data = _subjects(120)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["g"]: (r["comparable"], r["concordant"], r["tied"]) for r in op.concordance(df, "t", "e", "s", ["g"]).collect()}
    for g in ("a", "b", "c"):
        assert got[g] == _brute_concordance([r for r in data if r[3] == g])


def test_intervals_are_cleaned_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(plan, "freeze", lambda df: written.append(df.columns) or df)
    gaps = spark.createDataFrame([("a", None, 4.0, 1.0), ("b", 0.0, 4.0, None)], "id string, start double, stop double, x double")
    assert rows(plan.fill_intervals(gaps, ["x"]), "id", "x") == [("a", 1.0), ("b", 1.0)]
    assert written == [["id", "start", "stop", "x"]]


def test_curve_per_subject_or_interval(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 5.0, False), ("a", 5.0, 9.0, True), ("b", 0.0, 9.0, False)],
        "id string, start double, stop double, e boolean",
    )
    assert rows(plan.exit_curve(df, "id", "e"), "t", "n", "d") == [(0.0, 2, 0), (9.0, 2, 1)]
    assert rows(plan.exit_curve(df, "id", "e", per_subject=False), "t", "n", "d") == [(0.0, 3, 0), (5.0, 3, 0), (9.0, 2, 1)]
    gaps = spark.createDataFrame([("a", None, 4.0, 1.0), ("b", 0.0, 4.0, None), ("c", 0.0, 0.0, 9.0), ("d", 1.0, 2.0, 4.0)],
                                 "id string, start double, stop double, x double")
    assert rows(plan.fill_intervals(gaps, ["x"]), "id", "start", "x") == [("a", 0.0, 1.0), ("b", 0.0, 2.5), ("d", 1.0, 4.0)]
