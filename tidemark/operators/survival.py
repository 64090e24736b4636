"""Interval data, survival curves, group tests and regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import ratio
from ..session import freeze
from .keys import null_safe_join
from .scan import (
    ROWS_PER_GROUP,
    following,
    last_known,
    ordered_scan,
    row_number,
    running_product,
    running_sum,
)


# ---- interval data ---------------------------------------------------------


def long_format(df: DataFrame, duration: str) -> DataFrame:
    """One interval per row, from zero to its duration."""
    rest = [c for c in df.columns if c != duration]
    return df.select(*rest, F.lit(0.0).alias("start"), F.col(duration).cast("double").alias("stop"))


def add_covariates(
    intervals: DataFrame,
    changes: DataFrame,
    key: str,
    time: str,
    event: str,
    cumulative: bool = False,
    prefix: str = "cumsum_",
    limit: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """Splits intervals where a covariate changes.

    Changes later than the last stop drop out, one at the stop makes an
    interval of no length.  Several changes at one time are added up.  Only the
    last piece keeps the event.  ``cumulative`` carries the running sum in
    columns with ``prefix``; before the first change a covariate is zero.
    Other columns keep what their interval states, a NULL too; pieces before
    the first interval have its values.
    """
    values = [c for c in changes.columns if c not in (key, time)]
    names = {c: prefix + c if cumulative else c for c in values}
    carried = [c for c in intervals.columns if c not in (key, "start", "stop", event)]
    plain = [c for c in carried if c not in names.values()]
    earlier = [c for c in carried if c in names.values()]
    # one value, so that a NULL in it is not taken for a gap
    stated = F.struct(F.lit(True).alias("_stated"), *[F.col(c) for c in plain])
    ends = intervals.groupBy(key).agg(
        F.max_by("stop", F.struct("start", "stop")).alias("_end"),
        F.max_by(event, F.struct("start", "stop")).alias("_event"),
        F.min_by(stated, "start").alias("_first_row"),
    )
    steps = freeze(
        changes.filter(F.col(time).isNotNull())
        .groupBy(key, F.col(time).cast("double").alias("start"))
        .agg(*[F.sum(F.col(c).cast("double")).alias(f"_new_{names[c]}") for c in values])
    )
    if cumulative:
        sums = {f"_run_{names[c]}": running_sum(f"_new_{names[c]}") for c in values}
        steps = ordered_scan(steps, [key], ["start"], sums, limit, steps).select(
            key, "start", *[F.col(f"_run_{names[c]}").alias(f"_new_{names[c]}") for c in values]
        )
    steps = steps.join(ends.select(key, "_end"), key).filter(F.col("start") <= F.col("_end")).drop("_end")
    fresh = [f"_new_{n}" for n in names.values()]
    points = (
        intervals.select(key, "start", stated.alias("_row"), *earlier)
        .unionByName(steps, allowMissingColumns=True)
        .groupBy(key, "start")
        .agg(*[F.max(c).alias(c) for c in ["_row", *earlier, *fresh]])
    )
    points = freeze(points).select(
        key,
        "start",
        "_row",
        *[
            F.coalesce(F.col(f"_new_{n}"), F.col(n).cast("double")).alias(n) if n in carried else F.col(f"_new_{n}").alias(n)
            for n in names.values()
        ],
    )
    calcs = {f"_last_{c}": last_known(c) for c in ["_row", *names.values()]}
    pieces = ordered_scan(points, [key], ["start"], {**calcs, "_next": following("start")}, limit)
    return pieces.join(ends, key).select(
        key,
        "start",
        F.coalesce("_next", "_end").alias("stop"),
        *[F.coalesce("_last__row", "_first_row")[c].alias(c) for c in plain],
        *[F.coalesce(f"_last_{c}", F.lit(0.0)).alias(c) for c in names.values()],
        (F.col("_event").cast("boolean") & F.col("_next").isNull()).alias(event),
    )


def event_rows(df: DataFrame, key: str, events: list[str]) -> DataFrame:
    """Matrix of event times to one row per entity and time with a 0/1 column per event."""
    long = df.unpivot([key], events, "_event", "duration").filter(F.col("duration").isNotNull())
    return long.groupBy(key, "duration").agg(
        *[F.max((F.col("_event") == e).cast("int")).alias(e) for e in events]
    )


def clean_intervals(df: DataFrame) -> DataFrame:
    """Drops intervals that are empty at zero or negative; a missing start becomes zero."""
    start, stop = F.col("start"), F.col("stop")
    empty = F.coalesce((start == stop) & (start == 0), F.lit(False))
    negative = F.coalesce(start < 0, F.lit(False)) | F.coalesce(stop < 0, F.lit(False))
    return df.filter(~empty & ~negative).withColumn("start", F.coalesce("start", F.lit(0.0)))


def last_intervals(df: DataFrame, key: str, event: str) -> DataFrame:
    """One subject per entity: its last stop and whether the event came."""
    return df.groupBy(key).agg(F.max("stop").alias("stop"), F.max(F.col(event).cast("boolean")).alias(event))


# ---- curves ----------------------------------------------------------------


def _counted(df: DataFrame, duration: str, event: str, by: list[str]) -> DataFrame:
    """Removals and deaths per distinct time, with a row at time zero."""
    def cell(t: Column, removed: Column, d: Column) -> Column:
        return F.struct(t.alias("t"), removed.cast("long").alias("removed"), d.cast("long").alias("d"))

    died = F.coalesce(F.col(event).cast("boolean").cast("int"), F.lit(0))
    subject = cell(F.col(duration).cast("double"), F.lit(1), died)
    # the zero rows collapse before the shuffle
    origin = cell(F.lit(0.0), F.lit(0), F.lit(0))
    cells = df.filter(F.col(duration).isNotNull()).select(*by, F.explode(F.array(subject, origin)).alias("c"))
    return cells.groupBy(*by, F.col("c.t").alias("t")).agg(F.sum("c.removed").alias("removed"), F.sum("c.d").alias("d"))


def life_table(
    df: DataFrame, duration: str, event: str, by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Per distinct time the number at risk ``n``, deaths ``d`` and all removals."""
    by = list(by)
    # written, so that counting its groups does not read the subjects again
    return _at_risk(freeze(_counted(df, duration, event, by)), by, limit)


def _at_risk(counts: DataFrame, by: list[str], limit: int | None) -> DataFrame:
    return ordered_scan(counts, by, [F.col("t").desc()], {"n": running_sum("removed")}, limit)


def kaplan_meier(
    df: DataFrame, duration: str, event: str, by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Survival with its Greenwood variance at every distinct time."""
    by = list(by)
    n, d = F.col("n"), F.col("d")
    counts = freeze(_counted(df, duration, event, by))
    table = _at_risk(counts, by, limit).withColumns(
        {
            "_factor": F.coalesce(1 - ratio("d", "n"), F.lit(1.0)),
            "_part": ratio("d", n.cast("double") * (n - d)),
        }
    )
    curve = ordered_scan(
        table, by, ["t"], {"survival": running_product("_factor"), "_sum": running_sum("_part")}, limit, counts
    )
    variance = F.col("survival") * F.col("survival") * F.coalesce("_sum", F.lit(0.0))
    return curve.select(*by, "t", "n", "d", "survival", variance.alias("variance"))


def _harmonic(x: Column) -> Column:
    """1 + 1/2 + ... + 1/x, exact below 50 and by its series beyond."""
    real = x.cast("double")
    exact = F.aggregate(
        F.when(x >= 1, F.sequence(F.lit(1).cast("long"), F.least(x, F.lit(50).cast("long")))).otherwise(
            F.array().cast("array<bigint>")
        ),
        F.lit(0.0),
        lambda total, i: total + 1 / i,
    )
    euler = 0.5772156649015329
    series = F.log(real) + euler + 1 / (2 * real) - 1 / (12 * real**2) + 1 / (120 * real**4)
    return F.when(x <= 50, exact).otherwise(series)


def nelson_aalen(
    df: DataFrame,
    duration: str,
    event: str,
    by: list[str] = (),
    smoothing: bool = True,
    limit: int | None = ROWS_PER_GROUP,
) -> DataFrame:
    """Cumulative hazard; smoothing lets tied deaths happen one after the other."""
    by = list(by)
    n, d = F.col("n"), F.col("d")
    step = _harmonic(n) - _harmonic(n - d) if smoothing else F.coalesce(ratio("d", "n"), F.lit(0.0))
    counts = freeze(_counted(df, duration, event, by))
    table = _at_risk(counts, by, limit).withColumn("_step", step)
    return ordered_scan(table, by, ["t"], {"hazard": running_sum("_step")}, limit, counts).select(
        *by, "t", "n", "d", "hazard"
    )


def survival_quantiles(curve: DataFrame, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """First time at which survival has fallen to one minus the probability."""
    wide = curve.groupBy(*by).agg(
        *[F.min(F.when(F.col("survival") <= 1 - p + 1e-12, F.col("t"))).alias(f"_{i}") for i, p in enumerate(probabilities)]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"_{i}").alias("t")) for i, p in enumerate(probabilities)])
    )
    return wide.select(*by, pairs.alias("q")).select(*by, "q.p", "q.t")


# ---- group test ------------------------------------------------------------


def _logrank_times(df: DataFrame, duration: str, event: str, group: str, groups: list, limit) -> DataFrame:
    """Per distinct time the deaths and numbers at risk of every group, one column each."""
    happened = F.col(event).cast("boolean")
    per_group = []
    for i, g in enumerate(groups):
        inside = F.col(group) == F.lit(g)
        per_group.append(F.count_if(inside).alias(f"_m{i}"))
        per_group.append(F.count_if(inside & happened).alias(f"d{i}"))
    counts = freeze(df.filter(F.col(group).isin(list(groups))).groupBy(F.col(duration).alias("t")).agg(*per_group))
    risk = {f"n{i}": running_sum(f"_m{i}") for i in range(len(groups))}
    at_risk = ordered_scan(counts, [], [F.col("t").desc()], risk, limit)
    total = sum((F.col(f"n{i}") for i in range(1, len(groups))), F.col("n0")).cast("double")
    deaths = sum((F.col(f"d{i}") for i in range(1, len(groups))), F.col("d0")).cast("double")
    return at_risk.withColumns({"n": total, "d": deaths})


def _covariance(i: int, j: int) -> Column:
    share = F.col(f"n{j}") / F.col("n")
    weight = F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1) * (F.col(f"n{i}") / F.col("n"))
    return F.coalesce(F.sum(F.when(F.col("n") > 1, weight * ((1 if i == j else 0) - share))), F.lit(0.0))


def logrank(
    df: DataFrame, duration: str, event: str, group: str, groups: list, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Observed and expected deaths and their variance per group."""
    times = _logrank_times(df, duration, event, group, groups, limit)
    row = times.agg(
        *[F.sum(f"d{i}").alias(f"o{i}") for i in range(len(groups))],
        *[F.sum(F.col("d") * F.col(f"n{i}") / F.col("n")).alias(f"e{i}") for i in range(len(groups))],
        *[_covariance(i, i).alias(f"v{i}") for i in range(len(groups))],
    )
    return row.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(g).alias(group), F.col(f"o{i}").alias("observed"),
                        F.col(f"e{i}").alias("expected"), F.col(f"v{i}").alias("variance"),
                    )
                    for i, g in enumerate(groups)
                ]
            )
        ).alias("g")
    ).select("g.*")


def logrank_test(
    df: DataFrame, duration: str, event: str, group: str, groups: list, limit: int | None = ROWS_PER_GROUP
) -> tuple[float, int, float]:
    """Chi-square, degrees of freedom and p-value; the sums over time come back as one row."""
    k = len(groups)
    times = _logrank_times(df, duration, event, group, groups, limit)
    row = times.agg(
        *[
            F.sum(F.col(f"d{i}") - F.col("d") * F.col(f"n{i}") / F.col("n")).alias(f"z{i}") for i in range(k - 1)
        ],
        *[_covariance(i, j).alias(f"c{i}_{j}") for i in range(k - 1) for j in range(k - 1)],
    ).first()
    z = np.array([row[f"z{i}"] for i in range(k - 1)])
    cov = np.array([[row[f"c{i}_{j}"] for j in range(k - 1)] for i in range(k - 1)])
    chi = float(z @ np.linalg.solve(cov, z))
    return chi, k - 1, chi_square_tail(chi, k - 1)


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability of a chi-square value above ``x``."""
    half = x / 2
    if degrees % 2:
        tail, term, power = math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half), 0.5
    else:
        tail, term, power = math.exp(-half), half * math.exp(-half), 1.0
    for _ in range((degrees - 1) // 2):
        tail += term
        power += 1
        term *= half / power
    return tail


# ---- proportional hazards --------------------------------------------------

_TIES_PER_ROW = 100_000
_TIE_SUMS = ("l", "a0", "a1", "b0", "b1", "b2")
_NORMAL_95 = 1.959963984540054


class HazardFit:
    """Coefficients of a proportional hazards model; ``converged`` says whether the last step was small enough."""

    def __init__(self, names, coef, error, likelihood, steps, means, converged):
        self.names, self.coef, self.error = list(names), coef, error
        self.likelihood, self.steps, self.means, self.converged = likelihood, steps, means, converged

    def summary(self, spark) -> DataFrame:
        """One row per covariate with its 95 % limits."""
        rows = []
        for name, coef, error in zip(self.names, self.coef, self.error):
            z = coef / error
            rows.append(
                (name, float(coef), math.exp(coef), float(error), float(coef - _NORMAL_95 * error),
                 float(coef + _NORMAL_95 * error), float(z), math.erfc(abs(z) / math.sqrt(2)), self.converged)
            )
        return spark.createDataFrame(
            rows, "covariate string, coef double, exp_coef double, se double, lower double, upper double, z double, "
            "p double, converged boolean"
        )

    def risk(self) -> Column:
        """Log partial hazard of a row."""
        return sum(
            (float(b) * (F.col(n).cast("double") - float(m)) for n, b, m in zip(self.names, self.coef, self.means)),
            F.lit(0.0),
        )


def cox_fit(
    df: DataFrame,
    covariates: list[str],
    duration: str,
    event: str,
    start: str | None = None,
    ties: str = "efron",
    steps: int = 25,
    tolerance: float = 1e-9,
    limit: int | None = ROWS_PER_GROUP,
) -> HazardFit:
    """Newton steps on the partial likelihood, halved while they lower it.

    Each step is one aggregate over the rows: sums per distinct time, running
    sums for the risk sets, one row of totals.  Only that row reaches the
    driver.  With ``start`` a row counts in the risk sets after its start.
    A model that does not settle in ``steps`` steps, or whose information is
    singular, comes back with ``converged`` false.
    """
    return _cox_fits(df, covariates, duration, event, None, [0], start, ties, steps, tolerance, limit)[0]


def cox_fit_folds(
    df: DataFrame,
    covariates: list[str],
    duration: str,
    event: str,
    fold: str,
    k: int,
    start: str | None = None,
    ties: str = "efron",
    steps: int = 25,
    tolerance: float = 1e-9,
    limit: int | None = ROWS_PER_GROUP,
) -> list[HazardFit]:
    """``cox_fit`` on the rows outside each fold 0..k-1, all fits in the same steps, so folds add no jobs."""
    return _cox_fits(df, covariates, duration, event, fold, list(range(k)), start, ties, steps, tolerance, limit)


def _cox_fits(df, covariates, duration, event, fold, models, start, ties, steps, tolerance, limit) -> list[HazardFit]:
    """One fit per entry of ``models``, on the rows whose ``fold`` is another one."""
    p = len(covariates)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]

    def taught(c: str, m: int) -> Column:
        return F.col(c) if fold is None else F.when(F.col(fold) != m, F.col(c))

    moments = df.agg(
        *[F.avg(taught(c, m)).alias(f"m{m}_{i}") for m in models for i, c in enumerate(covariates)],
        *[F.stddev_pop(taught(c, m)).alias(f"s{m}_{i}") for m in models for i, c in enumerate(covariates)],
    ).first()
    means = {m: np.array([float(moments[f"m{m}_{i}"]) for i in range(p)]) for m in models}
    scales = {m: np.array([float(moments[f"s{m}_{i}"]) or 1.0 for i in range(p)]) for m in models}
    names = [f"c{i}" for i in range(p)]
    slim = df.select(
        (F.col(fold) if fold else F.lit(-1)).cast("int").alias("_fold"),
        F.col(duration).cast("double").alias("_t"),
        (F.col(start).cast("double") if start else F.lit(None).cast("double")).alias("_from"),
        F.col(event).cast("boolean").alias("_e"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(covariates, names)],
    )
    # equal rows count as one of their number
    data = freeze(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    # the times stay the same in every step, so their number is checked once
    if limit is not None and data.select(F.explode(F.array("_t", "_from"))).distinct().count() * 2 <= limit:
        limit = None

    def evaluate(points: dict[int, np.ndarray]) -> dict:
        told = [
            (m, *[float(v) for v in point], *[float(v) for v in means[m]], *[float(v) for v in scales[m]])
            for m, point in points.items()
        ]
        fields = [f"{kind}{i} double" for kind in ("beta", "mean", "scale") for i in range(p)]
        stated = df.sparkSession.createDataFrame(told, ", ".join(["model int", *fields]))
        return _cox_step(data, stated, p, pairs, ties, start is not None, limit)

    beta = {m: np.zeros(p) for m in models}
    at = evaluate(beta)
    if len(at) < len(models):
        raise ValueError("a hazard model needs events")
    taken, converged = dict.fromkeys(models, 0), dict.fromkeys(models, False)
    move, size, tries = {}, {}, {}
    going = list(models)
    while True:
        for m in [m for m in going if m not in move]:
            try:
                if taken[m] >= steps or converged[m]:
                    raise StopIteration
                step = np.linalg.solve(at[m][2], at[m][1])
            except (np.linalg.LinAlgError, StopIteration):
                going.remove(m)
                continue
            taken[m] += 1
            size[m] = float(np.abs(step).max())
            move[m], tries[m] = step * min(1.0, 5.0 / size[m] if size[m] else 1.0), 0
        if not going:
            break
        found = evaluate({m: beta[m] + move[m] for m in going})
        for m in going:
            tries[m] += 1
            likelihood, here = at[m][0], found[m]
            better = here[0] is not None and here[0] >= likelihood - 1e-9 * abs(likelihood)
            if not better:
                move[m] = move[m] / 2
            if better or tries[m] == 20:
                beta[m], at[m] = beta[m] + move.pop(m), here
                converged[m] = size[m] < tolerance
    fits = []
    for m in models:
        try:
            error = np.sqrt(np.diag(np.linalg.inv(at[m][2]))) / scales[m]
        except np.linalg.LinAlgError:
            error, converged[m] = np.full(p, np.nan), False
        fits.append(HazardFit(covariates, beta[m] / scales[m], error, at[m][0], taken[m], means[m], converged[m]))
    return fits


def _tied(most: int):
    """Adds Efron's sums over the ties of each row, of which ``_block`` names at most ``most``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            deaths, r0, b0, block = (
                batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "r_a0", "b0", "_block")
            )
            first = block.astype("int64") * most
            n = np.minimum(first + most, deaths.astype("int64")) - first
            out = np.zeros((6, len(n)))
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                # as many rows as have about a million ties
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + 1_000_000, side="right")))
                own = np.repeat(np.arange(begin, end), n[begin:end])
                tie = np.arange(len(own)) - np.repeat(ends[begin:end] - n[begin:end] - ends[begin] + n[begin], n[begin:end])
                f = (first[own] + tie) / deaths[own]
                s0 = r0[own] - f * b0[own]
                with np.errstate(all="ignore"):
                    one = 1 / s0
                    values = (np.log(s0), one, f * one, one * one, f * one * one, f * f * one * one)
                for i, value in enumerate(values):
                    out[i, begin:end] = np.bincount(own - begin, value, end - begin)
                begin = end
            gaps = batch.column(batch.schema.get_field_index("r_a0")).is_null().to_numpy(zero_copy_only=False)
            added = [pa.array(row, mask=gaps) for row in out]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *[f"s_{c}" for c in ("l", "a0", "a1", "b0", "b1", "b2")]]
            )

    return run


def _cox_step(data: DataFrame, stated: DataFrame, p: int, pairs, ties: str, entering: bool, limit) -> dict:
    """Per model its likelihood, gradient and information at its coefficients; ``stated`` has one row per model."""
    x = [F.col(f"x{i}") for i in range(p)]
    # the coefficients come as rows, so that every step runs the same compiled plan
    scaled = data.join(F.broadcast(stated), F.col("_fold") != F.col("model")).select(
        "model", "_t", "_from", "_e", "_n",
        *[((F.col(f"c{i}") - F.col(f"mean{i}")) / F.col(f"scale{i}")).alias(f"x{i}") for i in range(p)],
        *[f"beta{i}" for i in range(p)],
    )
    risk = sum((F.col(f"beta{i}") * xi for i, xi in enumerate(x)), F.lit(0.0))
    weighted = scaled.withColumn("_r", risk).withColumn("_w", F.col("_n") * F.exp("_r"))
    w, n, dead = F.col("_w"), F.col("_n"), F.col("_e")

    def parts(sign: int) -> list[Column]:
        factor = w * sign
        return (
            [factor.alias("a0")]
            + [(factor * x[i]).alias(f"a1_{i}") for i in range(p)]
            + [(factor * x[i] * x[j]).alias(f"a2_{i}_{j}") for i, j in pairs]
        )

    risk_names = ["a0"] + [f"a1_{i}" for i in range(p)] + [f"a2_{i}_{j}" for i, j in pairs]
    event_values = (
        [F.when(dead, n).otherwise(0.0).alias("k"), F.when(dead, n * F.col("_r")).alias("kr")]
        + [F.when(dead, n * x[i]).alias(f"kx_{i}") for i in range(p)]
        + [F.when(dead, w).alias("b0")]
        + [F.when(dead, w * x[i]).alias(f"b1_{i}") for i in range(p)]
        + [F.when(dead, w * x[i] * x[j]).alias(f"b2_{i}_{j}") for i, j in pairs]
    )
    event_names = ["k", "kr"] + [f"kx_{i}" for i in range(p)] + ["b0"] + [f"b1_{i}" for i in range(p)] + [
        f"b2_{i}_{j}" for i, j in pairs
    ]
    # a row leaves the risk sets above its time and, if it has a start, up to that start
    rows = weighted.select("model", F.col("_t").alias("t"), F.lit(False).alias("_entry"), *parts(1), *event_values)
    if entering:
        entries = weighted.filter(F.col("_from").isNotNull()).select(
            "model", F.col("_from").alias("t"), F.lit(True).alias("_entry"), *parts(-1)
        )
        rows = rows.unionByName(entries, allowMissingColumns=True)
    per_time = rows.groupBy("model", "t", "_entry").agg(
        *[F.sum(c).alias(c) for c in risk_names], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in event_names]
    )
    # entries at a time count for that time, since the risk set needs start < t
    sums = ordered_scan(
        per_time, ["model"], [F.col("t").desc(), F.col("_entry").desc()],
        {f"r_{c}": running_sum(c) for c in risk_names}, limit,
    ).filter(F.col("k") > 0)
    r0, b0, k = F.col("r_a0"), F.col("b0"), F.col("k")
    if ties == "efron":
        # sums over the ties of f^m / s0 and f^m / s0^2 with f = tie / k, made beside the row
        sums = sums.withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.floor((k - 1) / _TIES_PER_ROW).cast("int")))
        )
        sums = sums.mapInArrow(
            _tied(_TIES_PER_ROW), StructType([*sums.schema.fields, *[StructField(f"s_{n}", DoubleType()) for n in _TIE_SUMS]])
        ).withColumn("_s", F.struct(*[F.col(f"s_{n}").alias(n) for n in _TIE_SUMS]))
        lead = F.when(F.col("_block") == 0, 1.0).otherwise(0.0)
    else:
        one = F.lit(0.0)
        sums = sums.withColumn("_s", F.struct(
            (k * F.log(r0)).alias("l"), (k / r0).alias("a0"), one.alias("a1"), (k / (r0 * r0)).alias("b0"),
            one.alias("b1"), one.alias("b2"),
        ))
        lead = F.lit(1.0)
    s = {n: F.col(f"_s.{n}") for n in ("l", "a0", "a1", "b0", "b1", "b2")}
    r1, d1 = [F.col(f"r_a1_{i}") for i in range(p)], [F.col(f"b1_{i}") for i in range(p)]

    def information(i: int, j: int) -> Column:
        square = r1[i] * r1[j] * s["b0"] - (r1[i] * d1[j] + r1[j] * d1[i]) * s["b1"] + d1[i] * d1[j] * s["b2"]
        return F.col(f"r_a2_{i}_{j}") * s["a0"] - F.col(f"b2_{i}_{j}") * s["a1"] - square

    found = sums.groupBy("model").agg(
        F.sum(lead * F.col("kr") - s["l"]).alias("l"),
        *[F.sum(lead * F.col(f"kx_{i}") - (r1[i] * s["a0"] - d1[i] * s["a1"])).alias(f"g{i}") for i in range(p)],
        *[F.sum(information(i, j)).alias(f"h{i}_{j}") for i, j in pairs],
    ).collect()
    told = {}
    for row in found:
        hessian = np.zeros((p, p))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
        told[row["model"]] = row["l"], np.array([row[f"g{i}"] for i in range(p)]), hessian
    return told


def baseline_hazard(
    df: DataFrame, fit: HazardFit, duration: str, event: str, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Breslow's cumulative hazard of a subject with mean covariates, per event time."""
    died = F.coalesce(F.col(event).cast("boolean").cast("long"), F.lit(0).cast("long"))
    per_time = freeze(
        df.filter(F.col(duration).isNotNull()).groupBy(F.col(duration).cast("double").alias("t")).agg(
            F.sum(F.exp(fit.risk())).alias("_w"), F.sum(died).alias("d")
        )
    )
    at_risk = ordered_scan(per_time, [], [F.col("t").desc()], {"_risk": running_sum("_w")}, limit)
    steps = at_risk.withColumn("_step", ratio("d", "_risk"))
    return ordered_scan(steps, [], ["t"], {"hazard": running_sum("_step")}, limit, per_time).filter("d > 0").select(
        "t", "d", "hazard"
    )


#: Times of a curve that meet a subject in one row.
BLOCK_TIMES = 1000


def _every_time(
    subjects: DataFrame, curve: DataFrame, names: list[str], limit: int | None, block: int = BLOCK_TIMES
) -> DataFrame:
    """Subjects with a struct ``c`` of (t, names) per row of the curve.

    The curve is cut into blocks of times; a subject is written once per block
    and meets the block's rows by its number, so no row or broadcast holds a
    whole curve.
    """
    numbered = ordered_scan(curve.select("t", *names), [], ["t"], {"_n": row_number()}, limit)
    blocks = freeze(
        numbered.groupBy(F.expr(f"(_n - 1) div {block}").alias("_block"))
        .agg(F.collect_list(F.struct("t", *names)).alias("_times"))
    )
    last = blocks.agg(F.max("_block")).first()[0] or 0
    spread = subjects.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")))
    return spread.join(blocks, "_block").withColumn("c", F.explode("_times")).drop("_block", "_times")


def subject_curves(
    baseline: DataFrame, subjects: DataFrame, fit: HazardFit, key: str, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Survival of each subject at every event time; a row per subject and time, so subjects are few or chosen."""
    scored = freeze(subjects.select(key, F.exp(fit.risk()).alias("_factor")))
    return _every_time(scored, baseline, ["hazard"], limit).select(
        key, "c.t", F.exp(-F.col("c.hazard") * F.col("_factor")).alias("survival")
    )


def additive_survival(
    cumulative: DataFrame, subjects: DataFrame, covariates: list[str], key: str, limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Survival of each subject at every event time by the functions of `additive_hazard`, with or without a baseline.

    The hazard of an additive model can fall below zero, the survival then
    exceeds one; it is returned as it is.  A missing covariate gives NULL.
    """
    chosen = freeze(subjects.select(key, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(covariates)]))
    names = [c for c in ("baseline",) if c in cumulative.columns] + list(covariates)
    hazard = F.lit(0.0)
    for name in names:
        part = F.col("c").getField(name)
        hazard += part if name not in covariates else part * F.col(f"_x{covariates.index(name)}")
    return _every_time(chosen, cumulative, names, limit).select(key, "c.t", F.exp(-hazard).alias("survival"))


def additive_hazard(
    df: DataFrame, covariates: list[str], duration: str, event: str, ridge: float = 0.0,
    limit: int | None = ROWS_PER_GROUP, intercept: bool = True,
) -> DataFrame:
    """Aalen's additive model: cumulative regression functions of every covariate and, with an intercept, of the baseline.

    Per event time one small matrix of sums over the risk set is solved; the
    rows themselves are read once.  A matrix that is singular, or nearly so as
    at the end of a study, adds nothing.
    """
    names = ["baseline"] * intercept + list(covariates)
    p = len(names)
    if not p:
        raise ValueError("a model without intercept needs a covariate")
    x = [F.lit(1.0)] * intercept + [F.col(c).cast("double") for c in covariates]
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    died = F.coalesce(F.col(event).cast("boolean"), F.lit(False))
    per_time = freeze(
        df.filter(F.col(duration).isNotNull()).groupBy(F.col(duration).cast("double").alias("t")).agg(
            *[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs],
            *[F.sum(F.when(died, x[i]).otherwise(0.0)).alias(f"d{i}") for i in range(p)],
            F.count_if(died).alias("deaths"),
        )
    )
    at_risk = ordered_scan(
        per_time, [], [F.col("t").desc()], {f"r{i}_{j}": running_sum(f"m{i}_{j}") for i, j in pairs}, limit
    ).filter("deaths > 0").select("t", *[f"r{i}_{j}" for i, j in pairs], *[f"d{i}" for i in range(p)])

    def solve(batches):
        for batch in batches:
            m = np.empty((len(batch), p, p))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = batch[f"r{i}_{j}"]
            m += ridge * np.eye(p)
            sound = np.linalg.det(m) > 1e-6 * np.prod(np.diagonal(m, axis1=1, axis2=2), axis=1)
            dead = batch[[f"d{i}" for i in range(p)]].to_numpy(dtype=float)
            out = np.zeros((len(batch), p))
            out[sound] = np.linalg.solve(m[sound], dead[sound][:, :, None])[:, :, 0]
            found = batch[["t"]].copy()
            for i in range(p):
                found[f"s{i}"] = out[:, i]
            yield found

    steps = freeze(at_risk.mapInPandas(solve, "t double, " + ", ".join(f"s{i} double" for i in range(p))))
    summed = ordered_scan(steps, [], ["t"], {f"c{i}": running_sum(f"s{i}") for i in range(p)}, limit)
    return summed.select("t", *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])


# ---- concordance -----------------------------------------------------------


def concordance(
    df: DataFrame, duration: str, event: str, score: str, by: list[str] = (), limit: int | None = ROWS_PER_GROUP
) -> DataFrame:
    """Share of comparable pairs in which the later time has the higher score.

    A pair is comparable if the earlier time is an event; at equal times an
    event comes before a censoring.  Equal scores count one half.

    Pairs are counted, not made.  Scores are ranked; a rank above another one
    differs from it first in some binary digit.  For every digit the later rows
    with a one are counted under the digits before, and earlier events with a
    zero look that count up, so each row is written once per digit.
    """
    by = list(by)
    rows = (
        df.filter(F.col(duration).isNotNull() & F.col(score).isNotNull())
        .groupBy(
            *by,
            F.col(duration).cast("double").alias("t"),
            F.col(event).cast("boolean").alias("e"),
            F.col(score).cast("double").alias("s"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    rows = freeze(rows)
    ranks = ordered_scan(rows.select("s").distinct(), [], ["s"], {"r": row_number()}, limit)
    ranked = freeze(rows.join(ranks, "s").withColumn("after", (~F.col("e")).cast("int")))
    digits = int(ranked.agg(F.max("r")).first()[0] or 0).bit_length()
    own = F.when(F.col("e"), F.col("n")).otherwise(0.0)

    def later(frame: DataFrame, keys: list[str], asks: Column, has: Column, name: str) -> DataFrame:
        """Sum of ``asks`` times the ``has`` of later rows with the same keys."""
        cells = freeze(frame.groupBy(*by, *keys, "t", "after").agg(F.sum(asks).alias("asks"), F.sum(has).alias("has")))
        run = ordered_scan(
            cells, by + keys, [F.col("t").desc(), F.col("after").desc()], {"seen": running_sum("has")}, limit
        )
        return run.groupBy(*by).agg(F.sum(F.col("asks") * (F.col("seen") - F.col("has"))).alias(name))

    comparable = later(ranked, [], own, F.col("n"), "comparable")
    tied = later(ranked, ["r"], own, F.col("n"), "tied")
    digit = F.explode(F.sequence(F.lit(0), F.lit(max(digits - 1, 0)))).alias("digit")
    spread = ranked.select(*by, "t", "after", "n", "e", "r", digit)
    one = F.expr("shiftright(r, digit) & 1") == 1
    nodes = spread.select(
        *by, "t", "after", "digit", F.expr("shiftright(r, digit + 1)").alias("head"),
        F.when(one, F.col("n")).otherwise(0.0).alias("ones"),
        F.when(~one & F.col("e"), F.col("n")).otherwise(0.0).alias("zeros"),
    ).filter((F.col("ones") > 0) | (F.col("zeros") > 0))
    above = later(nodes, ["digit", "head"], F.col("zeros"), F.col("ones"), "concordant")
    total = null_safe_join(null_safe_join(comparable, tied, by), above, by)
    return total.select(
        *by, "comparable", "concordant", "tied",
        ratio(F.col("concordant") + 0.5 * F.col("tied"), "comparable").alias("concordance"),
    )
