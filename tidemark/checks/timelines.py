"""Entity frame and event timeline."""

from pyspark.sql import functions as F

from ..plans import timeline as plan
from ..session import freeze
from . import check
from .frames import entity, sources
from .standin_sql import BASE, EVENTS


@check(BASE + """
SELECT id, name, category_code, status, dates, ROUND(latitude, 6) AS latitude, ROUND(longitude, 6) AS longitude,
       CAST(offices AS BIGINT) AS offices, CAST(products AS BIGINT) AS products, CAST(experience AS BIGINT) AS experience
FROM entity""")
def entity_frame(spark, folder):
    return entity(sources(spark, folder)).withColumns(
        {"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)}
    )


@check(EVENTS + """
SELECT id, dates, event_id, CAST(seq AS BIGINT) AS seq, ROUND(famt, 6) AS famt, CAST(investors AS BIGINT) AS investors,
       ROUND(famt_cumsum, 4) AS famt_cumsum, ROUND(iamt, 6) AS iamt, CAST(iparts AS BIGINT) AS iparts,
       ROUND(aamt, 6) AS aamt, CAST(time_to_event AS BIGINT) AS time_to_event,
       CAST(event_count AS BIGINT) AS event_count, CAST(time_diff AS BIGINT) AS time_diff
FROM timeline""")
def event_timeline(spark, folder):
    s = sources(spark, folder)
    frame = plan.event_timeline(s, freeze(entity(s)))
    return frame.withColumns(
        {
            **{c: F.round(c, 6) for c in ("famt", "iamt", "aamt")},
            "famt_cumsum": F.round("famt_cumsum", 4),
            **{c: F.col(c).cast("long") for c in ("investors", "iparts", "time_to_event", "time_diff")},
        }
    )
