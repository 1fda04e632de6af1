"""Playlist strategies and playlist maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from auricle.io import load
from auricle.operators import merge, playlist, search
from auricle.plans.library import LIB, deduped, grouped_library, library
from auricle.sources.sinks import playlist_lines

MOODS = ["hazy", "bright", "calm", "restless"]
CUSTOM = {
    "genres": ["techno", "trance", "ambient", "electro", "deep house", "jazz"],
    "bpm_min": 80,
    "bpm_max": 170,
    "include_moods": MOODS,
    "exclude_moods": ["icy"],
    "min_popularity": 20,
    "limit": 50,
}


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("metadata_id", *columns, F.col("position").cast("long").alias("position"))


def q01_playlist_custom(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("custom", grouped_library(spark, d), CUSTOM), "listeners")


def q02_playlist_genre(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("genre", grouped_library(spark, d), {"genre": "techno"}), "genre_confidence")


def q03_playlist_bpm_range(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("bpm_range", grouped_library(spark, d), {"bpm_min": 120, "bpm_max": 128}), "bpm")


def q04_playlist_year_range(spark: SparkSession, d: str) -> DataFrame:
    p = {"year_min": 1995, "year_max": 2005, "sort_by": "popularity"}
    return _out(playlist.generate("year_range", grouped_library(spark, d), p), "year", "listeners")


def q05_playlist_decade(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("decade", grouped_library(spark, d), {"decade": "1990s"}), "year", "bpm")


def q06_playlist_mood(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("mood", grouped_library(spark, d), {"mood": "hazy"}), "danceability", "energy")


def q07_energy_arc(spark: SparkSession, d: str) -> DataFrame:
    return _out(playlist.generate("energy_arc", grouped_library(spark, d), {"limit": 40}), "energy")


def _seed(rows: DataFrame) -> str:
    got = rows.where("camelot_key is not null").agg(F.min("metadata_id")).first()[0]
    return got or ""


def q08_camelot_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_library(spark, d)
    return playlist.generate("camelot_chain", rows, {"seed_id": _seed(load(spark, d, "technical_features").where("duration_ms is not null").withColumn("camelot_key", F.lit("x"))), "limit": 30})


def q09_harmonic_chain(spark: SparkSession, d: str) -> DataFrame:
    return playlist.generate("custom", grouped_library(spark, d), {"sort_by": "harmonic", "bpm_min": 80, "bpm_max": 170, "limit": 30})


def q63_curated_pool(spark: SparkSession, d: str) -> DataFrame:
    """Several dimensions and a tag set; copies are left out, the best by confidence stay."""
    tagged = load(spark, d, "artist_stats").where(F.col("genres").ilike("%trance%")).select("metadata_id").distinct()
    rows = grouped_library(spark, d).where(F.col("energy").between(0.3, 0.9) & F.col("bpm").between(90, 150) & (F.col("genre_confidence") >= 0.3))
    pool = rows.join(tagged, "metadata_id", "left_semi")
    return _out(playlist.ranked(pool, [(F.coalesce("genre_confidence", F.lit(0.0)), True)], 150), "genre_confidence")


# --- lists of items: orders stand for playlists, their lines for members ------------------------


def members(spark: SparkSession, d: str) -> DataFrame:
    """(list_id, item_id, position) with positions made unique by a full order."""
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_partkey").alias("item_id"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    order = [F.col(c) for c in ("l_linenumber", "item_id", "l_suppkey", "l_quantity", "l_extendedprice")]
    return merge.compact(lines, "list_id", "position", order).select("list_id", "item_id", F.col("position").cast("long").alias("position"))


_MEMBERS = """members AS (SELECT l_orderkey AS list_id, l_partkey AS item_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS position FROM lineitem)"""


def q32_reorder_position(spark: SparkSession, d: str) -> DataFrame:
    return merge.move_to(members(spark, d), "list_id", "position", 2, 5).withColumn("position", F.col("position").cast("long"))


def q33_remove_compact(spark: SparkSession, d: str) -> DataFrame:
    left = members(spark, d).where("position != 3")
    return merge.compact(left, "list_id", "position", [F.col("position")]).withColumn("position", F.col("position").cast("long"))


def q34_move_swap(spark: SparkSession, d: str) -> DataFrame:
    return merge.swap_up(members(spark, d), "list_id", "position", 3).withColumn("position", F.col("position").cast("long"))


def q27_playlist_detail_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per list: size, tempo range and the three most common keys (ties: first seen)."""
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("bpm"), F.col("p_brand").alias("key"))
    rows = members(spark, d).join(parts, "item_id", "left")
    stats = rows.groupBy("list_id").agg(F.count("*").alias("tracks"), F.min("bpm").alias("bpm_min"), F.max("bpm").alias("bpm_max"))
    keys = rows.where("key is not null").groupBy("list_id", "key").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    ranked = keys.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "key"))).alias("k"))
    top = F.array_join(F.transform(F.slice("k", 1, 3), lambda x: x["key"]), ",")
    return stats.join(ranked.select("list_id", top.alias("top_keys")), "list_id", "left")


def q28_playlist_sort_presets(spark: SparkSession, d: str) -> DataFrame:
    """Rank inside each genre by key number, then letter; unreadable keys last."""
    w = Window.partitionBy("genre_primary").orderBy(*search.preset("key_asc"))
    rows = library(spark, d).where("genre_primary is not null")
    return rows.select("metadata_id", "genre_primary", F.row_number().over(w).cast("long").alias("rank"))


def q29_m3u8_lines(spark: SparkSession, d: str) -> DataFrame:
    """Albums as playlists in id order."""
    rows = library(spark, d).where("album is not null and album != ''")
    w = Window.partitionBy("album", "artist").orderBy("metadata_id")
    listed = rows.withColumn("position", F.row_number().over(w)).withColumn("list_id", F.concat_ws("|", "album", F.coalesce("artist", F.lit("")), F.lit("x")))
    return playlist_lines(listed.select("list_id", "position", "artist", "title", "duration_ms", "full_path"), "list_id")


def q56_audit_duplicates(spark: SparkSession, d: str) -> DataFrame:
    from auricle.operators.resolve import audit

    return audit(members(spark, d), "list_id", "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        q01_playlist_custom, q02_playlist_genre, q03_playlist_bpm_range, q04_playlist_year_range, q05_playlist_decade, q06_playlist_mood, q07_energy_arc,
        q08_camelot_chain, q09_harmonic_chain, q27_playlist_detail_stats, q28_playlist_sort_presets, q29_m3u8_lines, q32_reorder_position,
        q33_remove_compact, q34_move_swap, q56_audit_duplicates, q63_curated_pool,
    )
}

_LIKE = " OR ".join(f"mood_tags ILIKE '%{m}%'" for m in MOODS)
_GENRES = ", ".join(f"'{g}'" for g in CUSTOM["genres"])
_YEAR = "coalesce(try_cast(regexp_extract(substr(year, 1, 4), '^(\\d+)', 1) AS INTEGER), 0)"

ORACLE = {
    "q01_playlist_custom": deduped(
        f"genre_primary IN ({_GENRES}) AND ({_LIKE}) AND (mood_tags IS NULL OR NOT mood_tags ILIKE '%icy%') AND bpm >= 80 AND bpm <= 170 AND coalesce(listeners, 0) >= 20",
        "coalesce(listeners, 0) DESC", 50, "metadata_id, listeners",
    ),
    "q02_playlist_genre": deduped("genre_primary = 'techno'", "coalesce(genre_confidence, 0) DESC", 50, "metadata_id, genre_confidence"),
    "q03_playlist_bpm_range": deduped("bpm BETWEEN 120 AND 128", "bpm", 50, "metadata_id, bpm"),
    "q04_playlist_year_range": deduped(f"year <> '' AND {_YEAR} BETWEEN 1995 AND 2005", "coalesce(listeners, 0) DESC", 50, "metadata_id, year, listeners"),
    "q05_playlist_decade": deduped(
        "CAST(floor(try_cast(substr(year, 1, 4) AS INTEGER) / 10) * 10 AS INTEGER)::VARCHAR || 's' = '1990s'", "year, coalesce(bpm, 9999)", 50, "metadata_id, year, bpm"
    ),
    "q06_playlist_mood": deduped("mood_tags ILIKE '%hazy%'", "coalesce(danceability, 0) DESC, coalesce(energy, 0) DESC", 50, "metadata_id, danceability, energy"),
    "q07_energy_arc": f"""WITH low AS ({deduped("energy IS NOT NULL", "energy", 40, "metadata_id, energy")}),
p AS (SELECT *, greatest(0, least(CAST(floor(count(*) OVER () * 0.6) AS BIGINT), count(*) OVER () - 1)) AS peak FROM low)
SELECT metadata_id, energy, row_number() OVER (ORDER BY position > peak + 1, CASE WHEN position > peak + 1 THEN -energy ELSE energy END, position) AS position FROM p""",
    "q27_playlist_detail_stats": f"""WITH {_MEMBERS}, r AS (SELECT m.*, p_size AS bpm, p_brand AS key FROM members m LEFT JOIN part ON item_id = p_partkey),
k AS (SELECT list_id, key, count(*) AS n, min(position) AS first FROM r WHERE key IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY n DESC, first) AS rn FROM k),
t AS (SELECT list_id, string_agg(key, ',' ORDER BY rn) AS top_keys FROM o WHERE rn <= 3 GROUP BY 1)
SELECT list_id, tracks, bpm_min, bpm_max, top_keys FROM (SELECT list_id, count(*) AS tracks, min(bpm) AS bpm_min, max(bpm) AS bpm_max FROM r GROUP BY 1) LEFT JOIN t USING (list_id)""",
    "q28_playlist_sort_presets": f"""WITH {LIB} SELECT metadata_id, genre_primary, row_number() OVER (PARTITION BY genre_primary ORDER BY
  CASE WHEN regexp_matches(camelot_key, '^\\d+[A-Za-z]$') THEN CAST(regexp_extract(camelot_key, '^(\\d+)', 1) AS INTEGER) ELSE 99 END,
  CASE WHEN regexp_matches(camelot_key, '^\\d+[A-Za-z]$') THEN right(camelot_key, 1) ELSE 'Z' END, metadata_id) AS rank FROM lib WHERE genre_primary IS NOT NULL""",
    "q29_m3u8_lines": f"""WITH {LIB}, l AS (SELECT album || '|' || coalesce(artist, '') || '|x' AS list_id, album, artist, metadata_id,
  '#EXTINF:' || coalesce(CAST(duration_ms // 1000 AS VARCHAR), '-1') || ',' || coalesce(nullif(artist, ''), 'Unknown') || ' - ' || coalesce(nullif(title, ''), 'Unknown')
  || CASE WHEN full_path IS NULL THEN '' ELSE chr(10) || full_path END AS line FROM lib WHERE album <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY album, artist ORDER BY metadata_id) AS position FROM l)
SELECT list_id, '#EXTM3U' || chr(10) || string_agg(line, chr(10) ORDER BY position, line) AS body FROM o GROUP BY list_id""",
    "q32_reorder_position": f"""WITH {_MEMBERS}, n AS (SELECT *, max(position) OVER (PARTITION BY list_id) AS n FROM members)
SELECT list_id, item_id, CAST(CASE WHEN n < 2 THEN position WHEN position = 2 THEN least(5, n) WHEN position > 2 AND position <= least(5, n) THEN position - 1 ELSE position END AS BIGINT) AS position FROM n""",
    "q33_remove_compact": f"""WITH {_MEMBERS} SELECT list_id, item_id, row_number() OVER (PARTITION BY list_id ORDER BY position) AS position FROM members WHERE position <> 3""",
    "q34_move_swap": f"""WITH {_MEMBERS}, n AS (SELECT *, max(position) OVER (PARTITION BY list_id) AS n FROM members)
SELECT list_id, item_id, CAST(CASE WHEN n >= 3 AND position = 3 THEN 2 WHEN n >= 3 AND position = 2 THEN 3 ELSE position END AS BIGINT) AS position FROM n""",
    "q56_audit_duplicates": f"""WITH {_MEMBERS} SELECT list_id, count(*) AS members, count(DISTINCT item_id) AS distinct_members, count(*) - count(DISTINCT item_id) AS repeats FROM members GROUP BY 1""",
    "q63_curated_pool": deduped(
        "energy BETWEEN 0.3 AND 0.9 AND bpm BETWEEN 90 AND 150 AND genre_confidence >= 0.3 AND metadata_id IN (SELECT metadata_id FROM artist_stats WHERE genres ILIKE '%trance%')",
        "coalesce(genre_confidence, 0) DESC", 150, "metadata_id, genre_confidence",
    ),
}
