"""Queries of the general training-data operators: malformed records and packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.io import load
from auricle.operators import malformed, packed


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    lines = malformed.line_errors(load(spark, d, "track_import_lines"))
    return lines.unionByName(malformed.track_errors(load(spark, d, "tracks")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_errors(spark, d).select("src_table", "rec_key")


def p1_clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return malformed.clean_lines(load(spark, d, "track_import_lines"))


def p1_clean_tracks(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks")
    bad = malformed.track_errors(tracks).select(F.col("rec_key").alias("metadata_id"))
    return tracks.join(bad, "metadata_id", "left_anti").select(
        "metadata_id",
        "title",
        malformed.length_in_seconds(F.col("length_seconds")).alias("length_seconds"),
        malformed.size_in_bytes(F.col("file_size")).alias("file_size"),
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packed.packed_fields(load(spark, d, "ml_features"), load(spark, d, "artist_stats"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(_packed(spark, d), keep_single=False)


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(_packed(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_errors, p1_clean_lines, p1_clean_tracks, p6_found, p6_values)}

_LENGTH_OK = r"^(\d+|\d+:[0-5]\d|\d+:[0-5]\d:[0-5]\d)$"
_SIZE_OK = r"^(\d+|\d+(\.\d{1,2})? ?(KB|MB|GB))$"
_BAD_TRACK = rf"""
    coalesce(regexp_matches(title, '[\x00-\x1F]'), false) OR coalesce(regexp_matches(title, '"[;,]"|;\S'), false)
    OR coalesce(length_seconds <> '' AND NOT regexp_matches(length_seconds, '{_LENGTH_OK}'), false)
    OR coalesce(file_size <> '' AND NOT regexp_matches(file_size, '{_SIZE_OK}'), false)"""

ORACLE = {
    "p1_clean_tracks": rf"""
SELECT metadata_id, title,
  CASE WHEN regexp_matches(length_seconds, '{_LENGTH_OK}') THEN
    list_reduce(list_transform(string_split(length_seconds, ':'), lambda p: CAST(p AS BIGINT)), lambda a, p: a * 60 + p) END AS length_seconds,
  CASE WHEN regexp_matches(file_size, '{_SIZE_OK}') THEN CAST(floor(
    CAST(regexp_extract(file_size, '^([0-9.]+)', 1) AS DECIMAL(30,2)) *
    CASE regexp_extract(file_size, '(KB|MB|GB)$', 1) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END) AS BIGINT) END AS file_size
FROM tracks WHERE NOT ({_BAD_TRACK})""",
}
