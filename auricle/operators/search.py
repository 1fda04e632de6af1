"""Faceted search, detail views and list orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions import features
from auricle.functions.coerce import blank

PAGE = 50
SORTABLE = ("title", "artist", "album", "year", "genre_primary")


def contains(text: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns])


def page(rows: DataFrame, text: str | None, equals: dict[str, object], sort: str, number: int, descending: bool = False) -> DataFrame:
    """One page: empty values last, then the sort column, then the id; unknown sort columns mean the title."""
    cond = F.lit(True)
    if text:
        cond = cond & contains(text, ["title", "artist", "album"])
    for column, value in equals.items():
        if value:
            cond = cond & (F.col(column) == F.lit(value))
    by = sort if sort in SORTABLE else "title"
    order = F.col(by).desc() if descending else F.col(by).asc()
    return rows.where(cond).orderBy(F.when(blank(F.col(by)), 1).otherwise(0), order, "metadata_id").offset(PAGE * max(0, number - 1)).limit(PAGE)


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def page_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / PAGE)).cast("long").alias("pages"))


def preset(name: str) -> list[Column]:
    """Stable orders of a playlist's view."""
    number, letter = features.camelot_rank(F.col("camelot_key"))
    orders = {
        "bpm_asc": [F.col("bpm").asc()],
        "bpm_desc": [F.col("bpm").desc()],
        "energy_asc": [F.col("energy").asc()],
        "energy_desc": [F.col("energy").desc()],
        "key_asc": [number.asc(), letter.asc()],
        "key_desc": [number.desc(), letter.desc()],
        "genre": [F.lower("genre_primary").asc()],
        "artist": [F.lower("artist").asc()],
    }
    return [*orders[name], F.col("metadata_id").asc()]
