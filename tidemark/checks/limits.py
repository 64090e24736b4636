"""Limits of survival quantiles and bands of survival curves."""

from pyspark.sql import functions as F

from ..operators import limits, survival
from . import check
from .survivals import _lines, _table_sql

SHARES = [0.1, 0.25, 0.5]
NORMAL, BRIDGE = 1.959963984540054, limits.bridge_supremum(0.05)


@check(_table_sql("priority") + f""",
died AS (
  SELECT priority, CAST(t AS DOUBLE) AS t, survival AS s, survival * survival * part AS v,
         LEAD(CAST(t AS DOUBLE)) OVER (PARTITION BY priority ORDER BY t) AS next FROM km WHERE d > 0
),
asked AS (SELECT d.*, q.p FROM died d, (SELECT UNNEST({SHARES}::DOUBLE[]) AS p) q),
tested AS (
  SELECT *, CASE WHEN s > 0 AND s < 1 AND v > 0
    THEN ABS(LN(-LN(s)) - LN(-LN(1 - p))) <= {NORMAL}::DOUBLE * ABS(1 / (s * LN(s))) * SQRT(v) ELSE FALSE END AS holds FROM asked
)
SELECT priority, p, MIN(t) FILTER (WHERE s <= 1 - p + 1e-12) AS t, MIN(t) FILTER (WHERE holds) AS lower,
       ARG_MAX(COALESCE(next, -1), t) FILTER (WHERE holds) AS upper
FROM tested GROUP BY priority, p""")
def survival_quantile_limits(spark, folder):
    """Quantiles with their limits; an open upper limit is shown as -1."""
    curve = survival.kaplan_meier(_lines(spark, folder), "duration", "event", ["priority"])
    found = limits.quantile_limits(curve, SHARES, ["priority"])
    return found.withColumn("upper", F.when(F.col("lower").isNotNull(), F.coalesce("upper", F.lit(-1.0))))


@check(_table_sql("priority") + f""",
sized AS (SELECT *, CAST(MAX(n) OVER (PARTITION BY priority) AS DOUBLE) AS size FROM km),
banded AS (
  SELECT *, CASE WHEN survival > 0 AND survival < 1
    THEN EXP({BRIDGE!r}::DOUBLE * (1 + size * part) / (SQRT(size) * LN(survival))) END AS theta FROM sized WHERE d > 0
)
SELECT priority, CAST(t AS DOUBLE) AS t, ROUND(POW(survival, 1 / theta), 6) AS lower, ROUND(POW(survival, theta), 6) AS upper
FROM banded""")
def survival_band(spark, folder):
    """Band that holds the whole curve of each group."""
    curve = survival.kaplan_meier(_lines(spark, folder), "duration", "event", ["priority"])
    return limits.simultaneous_band(curve, ["priority"]).select(
        "priority", "t", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper")
    )
