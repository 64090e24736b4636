"""Registered queries, each with its SQL check where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def check(sql: str | None = None):
    """Registers a query under its function name, with the SQL it must equal."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def load() -> None:
    from . import basics, evaluation, kernels, labelling, limits, modelling, reports, scans, statics, survivals, timelines  # noqa: F401
