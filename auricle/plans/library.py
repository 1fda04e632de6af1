"""The joined library view that playlist, search and dedup queries start from, in both dialects.

Tempo, key and energy are not among the given tables; they are derived from the
technical ones by fixed formulas so that every operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions.text import BRACKET_VERSION, DASH_VERSION, base_title
from auricle.io import load


def popularity(spark: SparkSession, d: str) -> DataFrame:
    """Best last.fm counts per track, aggregated before any join."""
    stats = load(spark, d, "artist_stats").where("source = 'lastfm'")
    return stats.groupBy("metadata_id").agg(F.max("listeners").alias("listeners"), F.max("play_count").alias("play_count"))


def library(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks").select("metadata_id", "title", "artist", "album", "year", "filename", "full_path", "genre")
    ml = load(spark, d, "ml_features").select("metadata_id", "genre_primary", "genre_confidence", "mood_tags", "danceability", "vocal_type")
    tech = load(spark, d, "technical_features").select(
        "metadata_id", "codec", "bitrate", "integrity_ok", "duration_ms", "loudness_db", "lowpass_cutoff_hz", "silence_ratio", "clipping_ratio"
    )
    ms = F.col("duration_ms")
    return (
        tracks.join(ml, "metadata_id", "left")
        .join(tech, "metadata_id", "left")
        .join(popularity(spark, d), "metadata_id", "left")
        .withColumn("bpm", (60 + F.expr("duration_ms div 1000") % 140).cast("double"))
        .withColumn("camelot_key", F.concat((ms % 12 + 1).cast("string"), F.when(ms % 2 == 0, "A").when(ms.isNotNull(), "B")))
        .withColumn("energy", F.when(F.col("loudness_db").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("loudness_db") + 30) / 30))))
        .drop("loudness_db")
    )


def grouped_library(spark: SparkSession, d: str) -> DataFrame:
    """The library with the keys of copies (act and title) and versions (act and base title); a key that one row has groups nothing."""
    act = F.lower(F.trim("artist"))
    key = lambda title: F.when((act != "") & (title != ""), F.concat_ws("|", act, title))
    rows = library(spark, d)
    return rows.withColumn("duplicate_group", key(F.lower(F.trim("title")))).withColumn("remix_group", key(F.lower(base_title(F.col("title")))))


LIB = """lib AS (
  SELECT t.metadata_id, t.title, t.artist, t.album, t.year, t.filename, t.full_path, t.genre, m.genre_primary, m.genre_confidence, m.mood_tags,
    m.danceability, m.vocal_type, x.codec, x.bitrate, x.integrity_ok, x.duration_ms, x.lowpass_cutoff_hz, x.silence_ratio, x.clipping_ratio,
    s.listeners, s.play_count, CAST(60 + (x.duration_ms // 1000) % 140 AS DOUBLE) AS bpm,
    CAST(x.duration_ms % 12 + 1 AS VARCHAR) || CASE WHEN x.duration_ms % 2 = 0 THEN 'A' WHEN x.duration_ms IS NOT NULL THEN 'B' END AS camelot_key,
    CASE WHEN x.loudness_db IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x.loudness_db + 30) / 30)) END AS energy
  FROM tracks t LEFT JOIN ml_features m USING (metadata_id) LEFT JOIN technical_features x USING (metadata_id)
  LEFT JOIN (SELECT metadata_id, max(listeners) AS listeners, max(play_count) AS play_count FROM artist_stats WHERE source = 'lastfm' GROUP BY 1) s
    USING (metadata_id))"""

BASE_SQL = f"""lower(CASE WHEN regexp_replace(title, '{BRACKET_VERSION}', '') <> title THEN trim(regexp_replace(title, '{BRACKET_VERSION}', ''))
  ELSE trim(regexp_replace(title, '{DASH_VERSION}', '')) END)"""

GROUPS = f"""keyed AS (SELECT metadata_id, lower(trim(artist)) AS ak, {BASE_SQL} AS rk FROM tracks),
remix AS (SELECT metadata_id, CASE WHEN ak <> '' AND rk <> '' AND count(*) OVER (PARTITION BY ak, rk) > 1 THEN ak || '|' || rk END AS remix_group FROM keyed)"""


def deduped(where: str, order: str, limit: int, columns: str) -> str:
    """The playlist form: filter, first of each group in order, limit, position. Copies share a base title, so one group kind decides."""
    return f"""WITH {LIB}, {GROUPS},
pool AS (SELECT lib.*, remix_group, row_number() OVER (PARTITION BY coalesce(remix_group, metadata_id) ORDER BY {order}, metadata_id) AS rn
  FROM lib JOIN remix USING (metadata_id) WHERE {where}),
top AS (SELECT *, row_number() OVER (ORDER BY {order}, metadata_id) AS position FROM pool WHERE rn = 1)
SELECT {columns}, position FROM top WHERE position <= {limit}"""
