"""Interval data, survival curves and group tests.

A line item is a subject: days from order to shipment are its duration, a
return is its event, the order priority its group.
"""

from pyspark.sql import functions as F

from ..functions.columns import days_between
from ..operators import survival as op
from ..plans import survival as plan
from ..plans.static import static_features
from ..session import freeze, tune
from . import check
from .frames import sources
from .standin_sql import BASE
from .statics import CODES, STATIC_SQL, TITLES, TODAY

GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LINES_SQL = """
WITH lines AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderpriority AS priority,
         abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) AS duration,
         l.l_returnflag = 'R' AS event, l.l_quantity AS quantity, l.l_discount AS discount
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
)
"""


def _lines(spark, folder):
    tune(spark)
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", F.col("o_orderpriority").alias("priority")
    )
    return spark.read.parquet(f"{folder}/lineitem.parquet").join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "priority",
        F.abs(days_between(F.to_date("o_orderdate"), F.to_date("l_shipdate"))).alias("duration"),
        (F.col("l_returnflag") == "R").alias("event"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
    )


def _table_sql(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {keys}t"
    zero = f"SELECT DISTINCT {keys}0, 0, 0 FROM lines" if by else "SELECT 0, 0, 0"
    return LINES_SQL + f""",
counts AS (
  SELECT {keys}t, SUM(removed) AS removed, SUM(d) AS d FROM (
    SELECT {keys}duration AS t, COUNT(*) AS removed, COUNT(*) FILTER (WHERE event) AS d FROM lines {group}
    UNION ALL {zero}) {group}
),
risk AS (SELECT *, SUM(removed) OVER ({part} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM counts),
km AS (
  SELECT {keys}t, n, d, PRODUCT(1 - d / CAST(n AS DOUBLE)) OVER w AS survival,
         COALESCE(SUM(d / NULLIF(CAST(n AS DOUBLE) * (n - d), 0)) OVER w, 0) AS part,
         SUM(d / CAST(n AS DOUBLE)) OVER w AS hazard,
         SUM(COALESCE(list_sum(list_transform(range(CAST(d AS BIGINT)), lambda i: 1.0::DOUBLE / (n - i))), 0)) OVER w AS smooth
  FROM risk WINDOW w AS ({part} ORDER BY t ROWS UNBOUNDED PRECEDING)
)
"""


KM_COLUMNS = """CAST(t AS DOUBLE) AS t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d,
       ROUND(survival, 6) AS survival, ROUND(survival * survival * part, 8) AS variance FROM km"""


@check(_table_sql() + "SELECT " + KM_COLUMNS)
def km_curve(spark, folder):
    return op.kaplan_meier(_lines(spark, folder), "duration", "event").withColumns(
        {"survival": F.round("survival", 6), "variance": F.round("variance", 8)}
    )


@check(_table_sql("priority") + "SELECT priority, " + KM_COLUMNS)
def km_by_group(spark, folder):
    return op.kaplan_meier(_lines(spark, folder), "duration", "event", ["priority"]).withColumns(
        {"survival": F.round("survival", 6), "variance": F.round("variance", 8)}
    )


@check(_table_sql() + """
SELECT CAST(t AS DOUBLE) AS t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d, ROUND(hazard, 6) AS hazard FROM km""")
def nelson_aalen(spark, folder):
    return op.nelson_aalen(_lines(spark, folder), "duration", "event", smoothing=False).withColumn(
        "hazard", F.round("hazard", 6)
    )


@check(_table_sql("priority") + """
SELECT priority, CAST(t AS DOUBLE) AS t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d, ROUND(smooth, 6) AS hazard
FROM km""")
def nelson_aalen_smoothed(spark, folder):
    return op.nelson_aalen(_lines(spark, folder), "duration", "event", ["priority"]).withColumn(
        "hazard", F.round("hazard", 6)
    )


@check(_table_sql("priority") + """
SELECT k.priority, q.p, MIN(CAST(t AS DOUBLE)) FILTER (WHERE survival <= 1 - q.p + 1e-12) AS t
FROM km k, (SELECT UNNEST([0.1::DOUBLE, 0.25, 0.5, 0.75]) AS p) q GROUP BY k.priority, q.p""")
def survival_quantile(spark, folder):
    curve = op.kaplan_meier(_lines(spark, folder), "duration", "event", ["priority"])
    return op.survival_quantiles(curve, [0.1, 0.25, 0.5, 0.75], ["priority"])


LOGRANK_SQL = LINES_SQL + """,
times AS (SELECT duration AS t, COUNT(*) FILTER (WHERE event) AS d FROM lines GROUP BY 1),
cells AS (SELECT priority, duration AS t, COUNT(*) AS m, COUNT(*) FILTER (WHERE event) AS d FROM lines GROUP BY 1, 2),
full_cells AS (
  SELECT g.priority, t.t, t.d, COALESCE(c.m, 0) AS m, COALESCE(c.d, 0) AS dg
  FROM times t CROSS JOIN (SELECT DISTINCT priority FROM lines) g LEFT JOIN cells c ON c.t = t.t AND c.priority = g.priority
),
risk AS (
  SELECT *, SUM(m) OVER (PARTITION BY priority ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS ng FROM full_cells
),
both_risk AS (SELECT *, SUM(ng) OVER (PARTITION BY t) AS n FROM risk)
SELECT priority, CAST(SUM(dg) AS BIGINT) AS observed, ROUND(SUM(d * ng / CAST(n AS DOUBLE)), 4) AS expected,
       ROUND(SUM(CASE WHEN n > 1 THEN d * (n - d) / CAST(n - 1 AS DOUBLE) * (ng / CAST(n AS DOUBLE)) * (1 - ng / CAST(n AS DOUBLE)) END), 4) AS variance
FROM both_risk GROUP BY priority"""


@check(LOGRANK_SQL)
def logrank(spark, folder):
    return op.logrank(_lines(spark, folder), "duration", "event", "priority", GROUPS).withColumns(
        {"expected": F.round("expected", 4), "variance": F.round("variance", 4)}
    )


@check(LINES_SQL + """,
cells AS (
  SELECT duration, event, quantity, COUNT(*)::DOUBLE AS n FROM lines GROUP BY 1, 2, 3
),
pairs AS (
  SELECT SUM(a.n * b.n) AS comparable, SUM(CASE WHEN b.quantity > a.quantity THEN a.n * b.n ELSE 0 END) AS concordant,
         SUM(CASE WHEN b.quantity = a.quantity THEN a.n * b.n ELSE 0 END) AS tied
  FROM cells a JOIN cells b ON a.event AND (b.duration > a.duration OR (b.duration = a.duration AND NOT b.event))
)
SELECT comparable, concordant, tied, ROUND((concordant + tied / 2) / comparable, 9) AS concordance FROM pairs""")
def concordance(spark, folder):
    return op.concordance(_lines(spark, folder), "duration", "event", "quantity").withColumn(
        "concordance", F.round("concordance", 9)
    )


@check(LINES_SQL + """
SELECT l_orderkey, l_linenumber, priority, 0.0::DOUBLE AS start, CAST(duration AS DOUBLE) AS stop, event FROM lines""")
def long_format(spark, folder):
    return op.long_format(_lines(spark, folder), "duration").select(
        "l_orderkey", "l_linenumber", "priority", "start", "stop", "event"
    )


INTERVALS_SQL = STATIC_SQL + """,
subjects AS (
  SELECT id, category_code, status IN ('acquired', 'ipo') AS success, CAST(age_at_exit AS DOUBLE) AS stop
  FROM static WHERE id IN (SELECT id FROM timed_rounds)
),
changes AS (
  SELECT c.id, CAST(date_diff('day', c.founded_at, f.funded_at) AS DOUBLE) AS t, SUM(f.raised_amount_usd) AS amount
  FROM companies c JOIN funding_rounds f ON f.object_id = c.id
  WHERE f.raised_amount_usd IS NOT NULL AND f.funded_at IS NOT NULL GROUP BY 1, 2
),
kept AS (
  SELECT g.id, g.t, g.amount, SUM(g.amount) OVER (PARTITION BY g.id ORDER BY g.t) AS total
  FROM changes g
),
points AS (
  SELECT id, t AS start, amount, total FROM kept JOIN subjects s USING (id) WHERE t <= s.stop
  UNION ALL SELECT id, 0, 0, COALESCE((SELECT MAX_BY(k.total, k.t) FROM kept k WHERE k.id = s.id AND k.t < 0 AND k.t <= s.stop), 0)
  FROM subjects s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = s.id AND k.t = 0 AND s.stop >= 0)
),
filled AS (
  SELECT p.id, p.start, s.category_code,
         CASE WHEN p.start = 0 AND p.amount = 0 THEN COALESCE(LAG(p.amount) OVER w, 0) ELSE p.amount END AS amount,
         p.total, LEAD(p.start) OVER w AS next_start, s.stop AS final_stop, s.success
  FROM points p JOIN subjects s USING (id) WINDOW w AS (PARTITION BY p.id ORDER BY p.start)
),
intervals AS (
  SELECT id, category_code, start, COALESCE(next_start, final_stop) AS stop, amount, total,
         success AND next_start IS NULL AS success
  FROM filled
)
"""


def _intervals(spark, folder):
    s = sources(spark, folder)
    static = static_features(s, TITLES, TODAY, CODES)
    return plan.survival_input(static, s["objects"], s["funding_rounds"])


@check(INTERVALS_SQL + """
SELECT id, category_code, start, stop, ROUND(amount, 4) AS raised_amount_usd,
       ROUND(total, 4) AS cumsum_raised_amount_usd, success FROM intervals""")
def covariate_intervals(spark, folder):
    return _intervals(spark, folder).withColumns(
        {c: F.round(c, 4) for c in ("raised_amount_usd", "cumsum_raised_amount_usd")}
    )


@check(INTERVALS_SQL + """
SELECT id, category_code, start, stop, ROUND(amount, 4) AS raised_amount_usd, success FROM intervals
WHERE NOT (start = stop AND start = 0) AND start >= 0 AND stop >= 0""")
def clean_intervals(spark, folder):
    return op.clean_intervals(_intervals(spark, folder)).withColumn(
        "raised_amount_usd", F.round("raised_amount_usd", 4)
    ).select("id", "category_code", "start", "stop", "raised_amount_usd", "success")


@check(BASE + """,
dates AS (
  SELECT id, date_diff('day', founded_at, last_funding_at) AS funded, date_diff('day', founded_at, closed_at) AS closed,
         (SELECT MIN(date_diff('day', o.founded_at, a.acquired_at)) FROM acquisitions a WHERE a.acquired_object_id = o.id) AS acquired
  FROM objects o WHERE founded_at IS NOT NULL
),
long AS (
  SELECT id, funded AS duration, 'funded' AS e FROM dates WHERE funded IS NOT NULL
  UNION ALL SELECT id, closed, 'closed' FROM dates WHERE closed IS NOT NULL
  UNION ALL SELECT id, acquired, 'acquired' FROM dates WHERE acquired IS NOT NULL
)
SELECT id, CAST(duration AS BIGINT) AS duration, CAST(MAX(CAST(e = 'funded' AS INTEGER)) AS BIGINT) AS funded,
       CAST(MAX(CAST(e = 'closed' AS INTEGER)) AS BIGINT) AS closed, CAST(MAX(CAST(e = 'acquired' AS INTEGER)) AS BIGINT) AS acquired
FROM long GROUP BY id, duration""")
def event_matrix_long(spark, folder):
    s = sources(spark, folder)
    matrix = plan.event_times(s["objects"], s["acquisitions"])
    kinds = ["funded", "closed", "acquired"]
    return op.event_rows(matrix, "id", kinds).select(
        "id", *[F.col(c).cast("long").alias(c) for c in ["duration", *kinds]]
    )


def _exit_sql(source: str) -> str:
    return INTERVALS_SQL + f""",
cleaned AS (SELECT * FROM intervals WHERE NOT (start = stop AND start = 0) AND start >= 0 AND stop >= 0),
subjects_km AS ({source}),
counts AS (
  SELECT t, SUM(removed) AS removed, SUM(d) AS d FROM (
    SELECT stop AS t, COUNT(*) AS removed, COUNT(*) FILTER (WHERE success) AS d FROM subjects_km GROUP BY 1
    UNION ALL SELECT 0, 0, 0) GROUP BY t
),
risk AS (SELECT *, SUM(removed) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM counts)
SELECT CAST(t AS DOUBLE) AS t, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d,
       ROUND(PRODUCT(1 - d / CAST(n AS DOUBLE)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS survival
FROM risk"""


def _exits(spark, folder, per_subject):
    cleaned = op.clean_intervals(_intervals(spark, folder))
    return plan.exit_curve(cleaned, "id", "success", per_subject).select(
        "t", "n", "d", F.round("survival", 6).alias("survival")
    )


@check(_exit_sql("SELECT id, MAX(stop) AS stop, BOOL_OR(success) AS success FROM cleaned GROUP BY id"))
def km_exits(spark, folder):
    return _exits(spark, folder, True)


@check(_exit_sql("SELECT stop, success FROM cleaned"))
def km_exits_per_interval(spark, folder):
    return _exits(spark, folder, False)


@check(LINES_SQL + """
SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS start, CAST(duration AS DOUBLE) AS stop, event,
       COALESCE(quantity, MEDIAN(quantity) OVER ()) AS quantity
FROM (SELECT * REPLACE (CASE WHEN priority <> '5-LOW' THEN quantity END AS quantity) FROM lines) WHERE duration > 0""")
def interval_fill(spark, folder):
    gaps = _lines(spark, folder).withColumn("quantity", F.when(F.col("priority") != "5-LOW", F.col("quantity")))
    return plan.fill_intervals(op.long_format(gaps, "duration"), ["quantity"]).select(
        "l_orderkey", "l_linenumber", "start", "stop", "event", "quantity"
    )


_PAIRS = [(1, 1), (1, 2), (2, 2)]


def _newton_sql(steps: int) -> str:
    """Newton steps for two covariates with Efron's ties, written out one after the other."""
    data = """,
data AS (
  SELECT duration AS t, event AS e, quantity - AVG(quantity) OVER () AS x1, discount - AVG(discount) OVER () AS x2 FROM lines
),
b0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS h11, 0.0::DOUBLE AS h12, 0.0::DOUBLE AS h22)"""
    parts = [LINES_SQL + data]
    sums = ["1.0", "x1", "x2"] + [f"x{i} * x{j}" for i, j in _PAIRS]
    names = ["0", "1", "2"] + [f"{i}{j}" for i, j in _PAIRS]
    for k in range(steps):
        at_risk = ", ".join(f"SUM(w * {x}) AS a{n}" for x, n in zip(sums, names))
        dead = ", ".join(f"COALESCE(SUM(w * {x}) FILTER (WHERE e), 0) AS d{n}" for x, n in zip(sums, names))
        running = ", ".join(f"SUM(a{n}) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS r{n}" for n in names)
        s = {n: f"(r{n} - f * d{n})" for n in names}
        gradient = ", ".join(f"SUM(kx{i} / k - {s[str(i)]} / {s['0']}) AS g{i}" for i in (1, 2))
        hessian = ", ".join(
            f"SUM({s[f'{i}{j}']} / {s['0']} - {s[str(i)]} * {s[str(j)]} / ({s['0']} * {s['0']})) AS h{i}{j}" for i, j in _PAIRS
        )
        parts.append(f"""
w{k} AS (SELECT t, e, x1, x2, EXP(b1 * x1 + b2 * x2) AS w FROM data, b{k}),
p{k} AS (
  SELECT t, {at_risk}, {dead}, COUNT(*) FILTER (WHERE e) AS k, SUM(x1) FILTER (WHERE e) AS kx1, SUM(x2) FILTER (WHERE e) AS kx2
  FROM w{k} GROUP BY t
),
r{k} AS (SELECT *, {running} FROM p{k}),
f{k} AS (SELECT *, UNNEST(range(CAST(k AS BIGINT))) / CAST(k AS DOUBLE) AS f FROM r{k} WHERE k > 0),
n{k} AS (SELECT {gradient}, {hessian} FROM f{k}),
b{k + 1} AS (
  SELECT b.b1 + (n.h22 * n.g1 - n.h12 * n.g2) / (n.h11 * n.h22 - n.h12 * n.h12) AS b1,
         b.b2 + (n.h11 * n.g2 - n.h12 * n.g1) / (n.h11 * n.h22 - n.h12 * n.h12) AS b2, n.h11, n.h12, n.h22
  FROM b{k} b, n{k} n
)""")
    return ",".join(parts)


NEWTON = 7
NEWTON_SQL = _newton_sql(NEWTON)


@check(NEWTON_SQL + f""",
fitted AS (
  SELECT 'quantity' AS covariate, b1 AS coef, SQRT(h22 / (h11 * h22 - h12 * h12)) AS se FROM b{NEWTON}
  UNION ALL SELECT 'discount', b2, SQRT(h11 / (h11 * h22 - h12 * h12)) FROM b{NEWTON}
)
SELECT covariate, ROUND(coef, 5) AS coef, ROUND(EXP(coef), 5) AS exp_coef, ROUND(se, 5) AS se, ROUND(coef / se, 4) AS z,
       ROUND(coef - 1.959963984540054 * se, 5) AS lower, ROUND(coef + 1.959963984540054 * se, 5) AS upper, TRUE AS converged
FROM fitted""")
def cox_ph(spark, folder):
    """Hazard of a return by quantity and discount."""
    fit = op.cox_fit(_lines(spark, folder), ["quantity", "discount"], "duration", "event")
    return fit.summary(spark).select(
        "covariate", *[F.round(c, 5).alias(c) for c in ("coef", "exp_coef", "se", "lower", "upper")],
        F.round("z", 4).alias("z"), "converged",
    )


@check(NEWTON_SQL + f""",
last AS (SELECT t, e, EXP(b1 * x1 + b2 * x2) AS w FROM data, b{NEWTON}),
per AS (SELECT t, SUM(w) AS w, COUNT(*) FILTER (WHERE e) AS d FROM last GROUP BY t),
base AS (SELECT t, d, d / SUM(w) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS step FROM per),
total AS (SELECT t, d, SUM(step) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS hazard FROM base),
means AS (SELECT AVG(quantity) AS m1, AVG(discount) AS m2 FROM lines),
factors AS (
  SELECT priority, EXP(b1 * (AVG(quantity) - ANY_VALUE(m1)) + b2 * (AVG(discount) - ANY_VALUE(m2))) AS factor
  FROM lines, means, b{NEWTON} GROUP BY priority, b1, b2
)
SELECT priority, CAST(t AS DOUBLE) AS t, ROUND(EXP(-hazard * factor), 6) AS survival FROM total, factors WHERE d > 0""")
def cox_survival(spark, folder):
    """Predicted survival of the mean subject of every priority."""
    lines = freeze(_lines(spark, folder))
    fit = op.cox_fit(lines, ["quantity", "discount"], "duration", "event")
    subjects = lines.groupBy("priority").agg(F.avg("quantity").alias("quantity"), F.avg("discount").alias("discount"))
    curves = op.subject_curves(op.baseline_hazard(lines, fit, "duration", "event"), subjects, fit, "priority")
    return curves.withColumn("survival", F.round("survival", 6))


@check(LINES_SQL + """,
per AS (
  SELECT duration AS t, COUNT(*)::DOUBLE AS n, SUM(quantity) AS x, SUM(discount) AS y, SUM(quantity * quantity) AS xx,
         SUM(quantity * discount) AS xy, SUM(discount * discount) AS yy, COUNT(*) FILTER (WHERE event) AS d,
         COALESCE(SUM(quantity) FILTER (WHERE event), 0) AS dx, COALESCE(SUM(discount) FILTER (WHERE event), 0) AS dy
  FROM lines GROUP BY 1
),
risk AS (
  SELECT t, d, dx, dy, SUM(n) OVER w AS n, SUM(x) OVER w AS x, SUM(y) OVER w AS y, SUM(xx) OVER w AS xx, SUM(xy) OVER w AS xy,
         SUM(yy) OVER w AS yy FROM per WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)
),
det AS (SELECT *, n * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y) AS det FROM risk WHERE d > 0),
solved AS (
  SELECT t, ((xx * yy - xy * xy) * d + (xy * y - x * yy) * dx + (x * xy - xx * y) * dy) / det AS b0,
         ((xy * y - x * yy) * d + (n * yy - y * y) * dx + (x * y - n * xy) * dy) / det AS b1,
         ((x * xy - xx * y) * d + (x * y - n * xy) * dx + (n * xx - x * x) * dy) / det AS b2, det > 1e-6 * n * xx * yy AS sound FROM det
),
steps AS (
  SELECT t, CASE WHEN sound THEN b0 ELSE 0 END AS b0, CASE WHEN sound THEN b1 ELSE 0 END AS b1, CASE WHEN sound THEN b2 ELSE 0 END AS b2
  FROM solved
)
SELECT CAST(t AS DOUBLE) AS t, ROUND(SUM(b0) OVER w, 5) + 0.0 AS baseline, ROUND(SUM(b1) OVER w, 5) + 0.0 AS quantity,
       ROUND(SUM(b2) OVER w, 5) + 0.0 AS discount
FROM steps WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def additive_hazard(spark, folder):
    """Cumulative additive hazard of a return by quantity and discount, while more than three lines are at risk."""
    lines = _lines(spark, folder)
    found = op.additive_hazard(lines, ["quantity", "discount"], "duration", "event")
    return found.select("t", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("baseline", "quantity", "discount")])


@check(LINES_SQL + """,
per AS (
  SELECT duration AS t, SUM(quantity * quantity) AS xx, SUM(quantity * discount) AS xy, SUM(discount * discount) AS yy,
         COUNT(*) FILTER (WHERE event) AS d, COALESCE(SUM(quantity) FILTER (WHERE event), 0) AS dx,
         COALESCE(SUM(discount) FILTER (WHERE event), 0) AS dy
  FROM lines GROUP BY 1
),
risk AS (
  SELECT t, d, dx, dy, SUM(xx) OVER w AS xx, SUM(xy) OVER w AS xy, SUM(yy) OVER w AS yy
  FROM per WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)
),
steps AS (
  SELECT t, CASE WHEN xx * yy - xy * xy > 1e-6 * xx * yy THEN (yy * dx - xy * dy) / (xx * yy - xy * xy) ELSE 0 END AS b1,
         CASE WHEN xx * yy - xy * xy > 1e-6 * xx * yy THEN (xx * dy - xy * dx) / (xx * yy - xy * xy) ELSE 0 END AS b2
  FROM risk WHERE d > 0
),
total AS (SELECT t, SUM(b1) OVER w AS b1, SUM(b2) OVER w AS b2 FROM steps WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
subjects AS (SELECT priority, AVG(quantity) AS x1, AVG(discount) AS x2 FROM lines GROUP BY 1)
SELECT priority, CAST(t AS DOUBLE) AS t, ROUND(EXP(-(b1 * x1 + b2 * x2)), 5) AS survival FROM total, subjects""")
def additive_survival(spark, folder):
    """Survival of the mean subject of every priority by the additive model without an intercept."""
    lines = freeze(_lines(spark, folder))
    names = ["quantity", "discount"]
    subjects = lines.groupBy("priority").agg(*[F.avg(c).alias(c) for c in names])
    cumulative = op.additive_hazard(lines, names, "duration", "event", intercept=False)
    curves = op.additive_survival(cumulative, subjects, names, "priority")
    return curves.withColumn("survival", F.round("survival", 5))


@check()
def cox_time_varying(spark, folder):
    """Hazard of an exit by funding received so far, over (start, stop] intervals."""
    intervals = op.clean_intervals(_intervals(spark, folder)).withColumns(
        {c: F.log1p(c) for c in ("raised_amount_usd", "cumsum_raised_amount_usd")}
    )
    names = ["raised_amount_usd", "cumsum_raised_amount_usd"]
    return op.cox_fit(intervals, names, "stop", "success", start="start").summary(spark)


@check()
def kfold_concordance(spark, folder):
    """Concordance on each of ten held-out folds."""
    lines = freeze(_lines(spark, folder).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "quantity", "duration")))
    return plan.kfold_concordance(lines, ["quantity", "discount"], "duration", "event", "key", k=10)
