"""Tiered list of files to prune: exact copies, poor files, overflow of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import features
from auricle.functions.text import core_title, folded

PRIORITY = {"safe_auto": 0, "review_fast": 1, "review_curate": 2}


def _rank() -> list[Column]:
    ok = F.when(F.col("integrity_ok") == 1, 1).otherwise(0)
    return [ok.desc(), F.coalesce("bitrate", F.lit(0)).desc(), F.coalesce("size", F.lit(0)).desc(), F.col("metadata_id")]


def _overflow(rows: DataFrame, artist: Column, title: Column, keep: int, tier: str, reason: str) -> DataFrame:
    """All but the best ``keep`` rows of each (artist, title)."""
    keyed = rows.withColumn("ka", artist).withColumn("kt", title).where("ka != '' and kt != ''")
    w = Window.partitionBy("ka", "kt").orderBy(*_rank())
    return (
        keyed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > keep).select("metadata_id", F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    )


def axe_list(rows: DataFrame) -> DataFrame:
    """(metadata_id, tier, reason), the strongest tier per track. Needs numeric ``size`` and ``seconds``."""
    exact = _overflow(rows, folded(F.col("artist")), folded(F.col("title")), 1, "safe_auto", "exact_duplicate_artist_title")
    reasons = features.prune_reasons(*[F.col(c) for c in ("seconds", "integrity_ok", "bitrate", "lowpass_cutoff_hz", "silence_ratio", "clipping_ratio")])
    poor = rows.select("metadata_id", F.lit("review_fast").alias("tier"), reasons.alias("reason")).where("reason != ''")
    extra = _overflow(rows, folded(F.col("artist")), core_title(F.col("title")), 2, "review_curate", "remix_family_overflow_keep2")
    level = F.create_map(*[x for t, p in PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    every = exact.unionByName(poor).unionByName(extra).withColumn("level", level[F.col("tier")])
    return every.groupBy("metadata_id").agg(F.min_by(F.struct("tier", "reason"), "level").alias("s")).select("metadata_id", "s.tier", "s.reason")


def axe_order(listed: DataFrame, tracks: DataFrame) -> DataFrame:
    """The list with its tracks in the order of tiers, acts and titles, without case."""
    level = F.create_map(*[x for t, p in PRIORITY.items() for x in (F.lit(t), F.lit(p))])
    named = listed.join(tracks.select("metadata_id", "artist", "title"), "metadata_id")
    return named.orderBy(level[F.col("tier")], F.lower(F.coalesce("artist", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))), "metadata_id")
