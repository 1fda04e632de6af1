"""Stages as functions from frames to frames, with per-row errors and outcome counts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.coerce import blank
from auricle.operators import merge

#: Stages in the order in which each one's input is complete (fixed values).
STAGES = ["import", "probe", "analyze", "ml_classify", "match", "enrich", "derive_signals", "writeback"]
OPTIONAL = {"ml_classify"}
RESULT = "metadata_id string, success boolean, data string, error string"


class Limiter:
    """At most ``per_second`` calls; one per partition, so the whole rate is divided by the partitions."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1.0 / per_second, clock, sleep, 0.0
        self.lock = threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


def call_adapter(rows: DataFrame, key: str, factory: Callable[[], Callable[[dict], str]], per_second: float) -> DataFrame:
    """(metadata_id, success, data, error): an adapter's answer for each row; failures are rows, not exceptions.

    ``factory`` builds the client once per partition.
    """
    parts = max(1, rows.rdd.getNumPartitions())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, limiter = factory(), Limiter(per_second / parts)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                limiter.wait()
                try:
                    out.append((row[key], True, client(row), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row[key], False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["metadata_id", "success", "data", "error"], dtype=object)

    return rows.mapInPandas(run, RESULT)


def through_cache(rows: DataFrame, key: str, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers from the cache, or else fetched; and the cache with the new answers."""
    hits = rows.join(cache, key).select(*cache.columns)
    fresh = fetch(rows.join(cache.select(key), key, "left_anti")).select(*cache.columns)
    return hits.unionByName(fresh), merge.insert_ignore(cache, fresh, [key], [F.col(key)])


def run_stages(state: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]], only: list[str] | None = None, optional: bool = False) -> DataFrame:
    """The stages in logical order; unregistered ones pass, optional ones run if asked."""
    for stage in STAGES:
        if (only and stage not in only) or (stage in OPTIONAL and not optional and not only):
            continue
        state = registry.get(stage, lambda df: df)(state)
    return state


def outcomes(results: DataFrame, column: str = "status") -> DataFrame:
    return results.groupBy(column).agg(F.count("*").alias("n"))


def relocation_status(sidecars: DataFrame, tracks: DataFrame) -> DataFrame:
    """(metadata_id, status, path): what a scan of sidecars finds about the known tracks."""
    known = tracks.select("metadata_id", F.col("full_path").alias("old_path"), F.col("hash_partial").alias("old_hash"))
    joined = sidecars.join(known, "metadata_id", "left")
    status = (
        F.when(F.col("metadata_id").isNull(), "error")
        .when(F.col("old_path").isNull(), "orphan")
        .when(F.col("path").isNull(), "missing")
        .when(F.col("path") == F.col("old_path"), "unchanged")
        .when(F.col("hash_partial") != F.col("old_hash"), "hash_mismatch")
        .otherwise("update")
    )
    return joined.select("metadata_id", status.alias("status"), "path")


def triage(files: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scanned files whose path is known, and new ones."""
    known = tracks.select(F.lower("full_path").alias("path_key")).distinct()
    keyed = files.withColumn("path_key", F.lower("path"))
    return keyed.join(known, "path_key", "left_semi"), keyed.join(known, "path_key", "left_anti")


def enrich(tracks: DataFrame, lastfm: DataFrame, recordings: DataFrame) -> DataFrame:
    """Album and year where they are empty: last.fm before recordings; years only from four digits."""
    year = F.substr("date", F.lit(1), F.lit(4))
    rec = recordings.select("metadata_id", F.col("album").alias("rec_album"), F.when(year.rlike(r"^\d{4}$"), year).alias("rec_year"))
    joined = tracks.join(lastfm.select("metadata_id", F.col("album").alias("lfm_album")), "metadata_id", "left").join(rec, "metadata_id", "left")
    fill = lambda c, *more: F.when(blank(F.col(c)), F.coalesce(*more, F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[fill("album", "lfm_album", "rec_album") if c == "album" else fill("year", "rec_year") if c == "year" else F.col(c) for c in tracks.columns])


def tag_confidence(count: Column) -> Column:
    return F.when(count > 0, count / 100)


def import_overrides(auto: DataFrame, overrides: DataFrame) -> DataFrame:
    """A user's choice, also that of none, beats the automatic match. ``overrides`` is (id, metadata_id)."""
    o = overrides.select("id", F.col("metadata_id").alias("chosen"), F.lit(True).alias("has"))
    joined = auto.join(o, "id", "left")
    target = F.when(F.col("has"), F.col("chosen")).otherwise(F.col("metadata_id"))
    confidence = F.when(F.col("has"), F.when(F.col("chosen").isNull(), "none").otherwise("exact")).otherwise(F.col("confidence"))
    return joined.select("id", target.alias("metadata_id"), confidence.alias("confidence"))
