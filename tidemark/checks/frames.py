"""Frames that several registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.entity import entity_frame
from ..plans.labels import outcome_labels, without_closed
from ..plans.timeline import event_timeline, on_timeline
from ..session import freeze, tune
from ..sources.standin import Sources

TITLES = "urgent|high"


def sources(spark: SparkSession, folder: str) -> Sources:
    return Sources(tune(spark), folder)


def entity(s: Sources) -> DataFrame:
    return entity_frame(s["objects"], s["offices"], s["relationships"], TITLES)


def single_timeline(s: Sources) -> DataFrame:
    """Timeline for one reading: nothing is written, so only the columns asked for are computed."""
    return event_timeline(s, entity(s))


def timeline(s: Sources) -> tuple[DataFrame, DataFrame]:
    """Timeline and entity frame, both written once: all later steps read them several times."""
    companies = freeze(entity(s))
    return freeze(event_timeline(s, companies)), companies


def live(s: Sources) -> tuple[DataFrame, DataFrame]:
    """Timeline and entity frame of the companies that were not closed."""
    frame, companies = timeline(s)
    companies, frame = without_closed(on_timeline(companies, frame), frame)
    return frame, companies


def labelled(s: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Timeline, entity frame and outcome labels of the companies that were not closed."""
    frame, companies = live(s)
    return frame, companies, freeze(outcome_labels(frame, companies))
