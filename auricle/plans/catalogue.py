"""The query catalogue: names to plans, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auricle.plans import data_quality, duplicates, feeds, playlists, signals, states, texts, upkeep, views

_MODULES = [playlists, duplicates, states, signals, upkeep, texts, feeds, views, data_quality]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
