"""Scalar features, text keys and array measures over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import features
from auricle.functions import text as txt
from auricle.io import load
from auricle.plans.library import BASE_SQL, LIB, library


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Spectral measures stand-ins per track, from technical columns by fixed formulas."""
    return library(spark, d).where("duration_ms is not null and lowpass_cutoff_hz is not null").select(
        "metadata_id",
        "bpm",
        "energy",
        (F.col("lowpass_cutoff_hz") / 3).alias("centroid"),
        F.coalesce("silence_ratio", F.lit(0.1)).alias("flatness"),
        (F.coalesce("clipping_ratio", F.lit(0.005)) * 10).alias("zcr"),
        (F.col("duration_ms") % 20).cast("double").alias("dynamic_range"),
        (F.col("duration_ms") % 1000 / 1000).alias("peak"),
        (F.col("duration_ms") % 7).cast("double").alias("onsets"),
    )


_FRAMES = f"""{LIB}, frames AS (SELECT metadata_id, bpm, energy, lowpass_cutoff_hz / 3 AS centroid, coalesce(silence_ratio, 0.1) AS flatness,
  coalesce(clipping_ratio, 0.005) * 10 AS zcr, CAST(duration_ms % 20 AS DOUBLE) AS dynamic_range, (duration_ms % 1000) / 1000 AS peak, CAST(duration_ms % 7 AS DOUBLE) AS onsets
  FROM lib WHERE duration_ms IS NOT NULL AND lowpass_cutoff_hz IS NOT NULL)"""
c = F.col


def q39_mood_tags(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("metadata_id", F.array_join(features.moods(c("bpm"), c("energy"), c("dynamic_range"), c("centroid")), ",").alias("moods"))


def q40_danceability(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("metadata_id", F.round(features.danceability(c("bpm"), c("energy"), c("onsets"), c("flatness")), 9).alias("danceability"))


def q41_acousticness(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("metadata_id", F.round(features.acousticness(c("flatness"), c("centroid"), c("zcr"), c("dynamic_range")), 9).alias("acousticness"))


def q42_quality(spark: SparkSession, d: str) -> DataFrame:
    q = features.quality(c("centroid"), c("flatness"), c("zcr"), c("dynamic_range"), c("peak"))
    return frames(spark, d).select("metadata_id", q.alias("q")).select("metadata_id", F.round("q.score", 6).alias("score"), F.array_join("q.issues", ",").alias("issues"))


def q43_tempo_energy_category(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("metadata_id", features.tempo_category(c("bpm")).alias("tempo"), features.energy_category(c("energy")).alias("energy_class"))


def q44_vocal_era(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("metadata_id", features.vocal_type(c("flatness"), c("zcr")).alias("vocal"), features.era(c("centroid"), c("energy")).alias("era"))


def q45_bpm_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Two noisy estimates per part."""
    p = load(spark, d, "part").select(
        "p_partkey", (c("p_size") + 60.0).alias("a"), F.when(c("p_partkey") % 5 == 0, None).when(c("p_partkey") % 3 == 0, (c("p_size") + 60.0) * 2).otherwise(c("p_size") + 60.0 + c("p_partkey") % 25).alias("b")
    )
    x = features.cross_check_bpm(c("a"), F.lit(0.85), c("b"), F.lit(0.8))
    return p.select("p_partkey", x.alias("x")).select("p_partkey", F.round("x.bpm", 6).alias("bpm"), F.round("x.confidence", 6).alias("confidence"), c("x.disagreement").cast("int").alias("disagreement"))


def q46_filename_parse(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tracks").select("metadata_id", txt.filename_parts(c("filename")).alias("p")).select("metadata_id", "p.artist", "p.title")


def q47_base_title(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tracks").where("title is not null").select("metadata_id", F.lower(txt.base_title(c("title"))).alias("base_key"))


def q48_path_canonical(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tracks").select("metadata_id", txt.canonical_path(c("full_path")).alias("path_key"))


def q57_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Most common mood field per genre (ties: the first by id) with its share."""
    rows = load(spark, d, "ml_features").where("genre_primary is not null and tempo_category is not null")
    n = rows.groupBy("genre_primary", "tempo_category").agg(F.count("*").alias("n"), F.min("metadata_id").alias("first"))
    best = n.groupBy("genre_primary").agg(F.min_by(F.struct("tempo_category", "n"), F.struct((-c("n")).alias("n"), "first")).alias("b"), F.sum("n").alias("all"))
    return best.select("genre_primary", c("b.tempo_category").alias("winner"), F.round(c("b.n") / c("all"), 6).alias("share"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    name = next(f.name for f in e.schema if f.dataType.typeName() == "array")
    key = e.columns[0]
    return e.select(c(key).alias("id"), c(name).cast("array<double>").alias("v"))


def q58_array_stats(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", F.round(features.mean(c("v")), 6).alias("mean"), F.round(features.deviation(c("v")), 5).alias("deviation"), F.round(F.array_max("v"), 6).alias("top"))


def q59_rolloff(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", features.rolloff(c("v"), 0.85).cast("long").alias("at"))


def q60_zero_crossings(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", features.zero_crossings(c("v")).cast("long").alias("crossings"))


def q64_bitrate_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "technical_features").select("metadata_id", "codec", F.expr("bitrate div 1000").alias("kbps"))
    return rows.select("metadata_id", features.target_bitrate(c("codec"), c("kbps")).cast("long").alias("target"))


def q65_conversion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Target path, rate and state of every file of a conversion to one codec."""
    rows = library(spark, d).select("metadata_id", "filename", "full_path", "codec", F.expr("bitrate div 1000").alias("kbps"))
    suffix = F.lower(F.regexp_extract("full_path", r"\.([A-Za-z0-9]+)$", 1))
    state = F.when(suffix == "opus", "skipped_existing").when(c("codec").isNull(), "missing_source").otherwise("planned")
    rank = F.when(suffix.isin("flac", "wav"), 0).when(suffix.isin("m4a", "ogg"), 1).otherwise(2)
    return rows.select("metadata_id", F.regexp_replace("full_path", r"\.[A-Za-z0-9]+$", ".opus").alias("target"), state.alias("state"), rank.cast("long").alias("priority"))


QUERIES = {
    f.__name__: f
    for f in (
        q39_mood_tags, q40_danceability, q41_acousticness, q42_quality, q43_tempo_energy_category, q44_vocal_era, q45_bpm_cross_check, q46_filename_parse,
        q47_base_title, q48_path_canonical, q57_majority_vote, q58_array_stats, q59_rolloff, q60_zero_crossings, q64_bitrate_ladder, q65_conversion_plan,
    )
}

_PREFIX = txt.NUMBER_PREFIX
_STEM = rf"regexp_replace(regexp_replace(regexp_extract(filename, '([^\\/]*)$', 1), '(.)\.[^.]*$', '\1'), '{_PREFIX}', '')"

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"

ORACLE = {
    "q58_array_stats": f"WITH {_V} SELECT id, round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 5) AS deviation, round(list_max(v), 6) AS top FROM v",
    "q59_rolloff": f"""WITH {_V}, u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
c AS (SELECT id, i, sum(x * x) OVER (PARTITION BY id ORDER BY i) AS s, sum(x * x) OVER (PARTITION BY id) AS t FROM u) SELECT id, CAST(min(i) - 1 AS BIGINT) AS at FROM c WHERE s >= 0.85::DOUBLE * t GROUP BY 1""",
    "q60_zero_crossings": f"WITH {_V} SELECT id, len(list_filter(range(1, len(v)), lambda i: (v[i] >= 0) <> (v[i + 1] >= 0))) AS crossings FROM v",
    "q39_mood_tags": f"""WITH {_FRAMES}, m AS (SELECT metadata_id, list_filter([CASE WHEN energy > 0.3 AND bpm > 120 THEN 'energetic' END, CASE WHEN energy < 0.15 THEN 'calm' END,
  CASE WHEN energy < 0.15 THEN 'relaxed' END, CASE WHEN dynamic_range > 10 THEN 'dynamic' END, CASE WHEN dynamic_range < 4 THEN 'monotoned' END, CASE WHEN centroid > 5000 THEN 'bright' END,
  CASE WHEN centroid < 2000 THEN 'dark' END, CASE WHEN bpm < 80 THEN 'melancholic' END, CASE WHEN bpm > 140 THEN 'uplifting' END, CASE WHEN bpm BETWEEN 125 AND 135 THEN 'danceable' END],
  lambda x: x IS NOT NULL) AS l FROM frames) SELECT metadata_id, CASE WHEN len(l) = 0 THEN 'neutral' ELSE array_to_string(l[1:5], ',') END AS moods FROM m""",
    "q40_danceability": f"WITH {_FRAMES} SELECT metadata_id, round(greatest(0, least(1, 1 - abs(bpm - 125) / 125)) * 0.3::DOUBLE + energy * 0.3::DOUBLE + least(1, onsets / 5) * 0.25::DOUBLE + (1 - flatness) * 0.15::DOUBLE, 9) AS danceability FROM frames",
    "q41_acousticness": f"WITH {_FRAMES} SELECT metadata_id, round(least(1, flatness * 3) * 0.3::DOUBLE + (1 - least(1, centroid / 8000)) * 0.3::DOUBLE + (1 - least(1, zcr * 10)) * 0.2::DOUBLE + least(1, dynamic_range / 10) * 0.2::DOUBLE, 9) AS acousticness FROM frames",
    "q42_quality": f"""WITH {_FRAMES}, q AS (SELECT metadata_id, [dynamic_range < 3, dynamic_range > 15, peak > 0.95, peak > 0.9 AND peak <= 0.95, flatness > 0.6, zcr > 0.25, centroid < 500] AS t FROM frames)
SELECT metadata_id, round(greatest(0, least(1, 0.8::DOUBLE - CASE WHEN t[1] THEN 0.2 ELSE 0 END - CASE WHEN t[2] THEN 0.1 ELSE 0 END - CASE WHEN t[3] THEN 0.3 ELSE 0 END - CASE WHEN t[4] THEN 0.15 ELSE 0 END
  - CASE WHEN t[5] THEN 0.15 ELSE 0 END - CASE WHEN t[6] THEN 0.1 ELSE 0 END - CASE WHEN t[7] THEN 0.15 ELSE 0 END)), 6) AS score,
  array_to_string(list_filter([CASE WHEN t[1] THEN 'low_dynamic_range' END, CASE WHEN t[2] THEN 'high_dynamic_range' END, CASE WHEN t[3] THEN 'clipping_detected' END, CASE WHEN t[4] THEN 'near_clipping' END,
    CASE WHEN t[5] THEN 'noise_floor_detected' END, CASE WHEN t[6] THEN 'high_noise' END, CASE WHEN t[7] THEN 'muffled_audio' END], lambda x: x IS NOT NULL), ',') AS issues FROM q""",
    "q43_tempo_energy_category": f"""WITH {_FRAMES} SELECT metadata_id, CASE WHEN bpm < 80 THEN 'slow' WHEN bpm < 100 THEN 'moderate' WHEN bpm < 120 THEN 'mid-tempo' WHEN bpm < 140 THEN 'upbeat' WHEN bpm < 170 THEN 'fast' ELSE 'very-fast' END AS tempo,
  CASE WHEN energy < 0.2 THEN 'very-low' WHEN energy < 0.4 THEN 'low' WHEN energy < 0.6 THEN 'medium' WHEN energy < 0.8 THEN 'high' ELSE 'very-high' END AS energy_class FROM frames""",
    "q44_vocal_era": f"""WITH {_FRAMES} SELECT metadata_id, CASE WHEN flatness > 0.35 THEN 'instrumental' WHEN zcr > 0.15 AND flatness > 0.2 THEN 'spoken' ELSE 'vocal' END AS vocal,
  CASE WHEN centroid > 6000 AND energy > 0.7 THEN '2020s' WHEN centroid > 4500 AND energy > 0.5 THEN '2010s' WHEN centroid > 3500 THEN '2000s' WHEN centroid > 2500 THEN '1990s'
  WHEN centroid < 2000 AND energy < 0.5 THEN '1980s' ELSE 'unknown' END AS era FROM frames""",
    "q45_bpm_cross_check": """WITH p AS (SELECT p_partkey, p_size + 60.0::DOUBLE AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN (p_size + 60.0::DOUBLE) * 2 ELSE p_size + 60.0::DOUBLE + p_partkey % 25 END AS b FROM part),
o AS (SELECT *, b IS NOT NULL AND abs(greatest(a, b) / least(a, b) - 2) < 0.1 AS oct, abs(a - b) <= 10 AS near FROM p)
SELECT p_partkey, round(CASE WHEN b IS NULL THEN a WHEN oct THEN greatest(a, b) WHEN near THEN (a + b) / 2 ELSE a END, 6) AS bpm,
  round(CASE WHEN b IS NULL THEN 0.85 WHEN oct THEN 0.85 WHEN near THEN 0.8 ELSE 0.85 * 0.6 END::DOUBLE, 6) AS confidence, CAST(b IS NOT NULL AND NOT oct AND NOT near AS INTEGER) AS disagreement FROM o""",
    "q46_filename_parse": f"""WITH s AS (SELECT metadata_id, {_STEM} AS s FROM tracks), p AS (SELECT metadata_id, s, instr(s, ' - ') AS cut FROM s),
h AS (SELECT *, trim(substr(s, 1, cut - 1)) AS l, trim(substr(s, cut + 3)) AS r FROM p), i AS (SELECT *, instr(r, ' - ') AS in_at, regexp_matches(l, '^\\d+$') AS num FROM h)
SELECT metadata_id, CASE WHEN cut = 0 THEN '' WHEN NOT num THEN l WHEN in_at > 0 THEN trim(substr(r, 1, in_at - 1)) ELSE '' END AS artist,
  regexp_replace(CASE WHEN cut = 0 THEN trim(s) WHEN NOT num THEN r WHEN in_at > 0 THEN trim(substr(r, in_at + 3)) ELSE r END, '(?i)\\s*\\(Unknown Artist\\)\\s*$', '') AS title FROM i""",
    "q47_base_title": f"SELECT metadata_id, {BASE_SQL} AS base_key FROM tracks WHERE title IS NOT NULL",
    "q48_path_canonical": r"SELECT metadata_id, lower(regexp_replace(regexp_replace(trim(replace(full_path, '\', '/')), '/+', '/', 'g'), '^/+|/+$', '', 'g')) AS path_key FROM tracks",
    "q57_majority_vote": """WITH n AS (SELECT genre_primary, tempo_category, count(*) AS n, min(metadata_id) AS first FROM ml_features WHERE genre_primary IS NOT NULL AND tempo_category IS NOT NULL GROUP BY 1, 2)
SELECT genre_primary, tempo_category AS winner, round(n / sum(n) OVER (PARTITION BY genre_primary), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY genre_primary ORDER BY n DESC, first) = 1""",
    "q64_bitrate_ladder": """SELECT metadata_id, CAST(CASE WHEN coalesce(bitrate // 1000, 0) <= 0 THEN 160 ELSE round_even(greatest(64, least(160, CASE WHEN lower(codec) IN ('mp3', 'aac', 'vorbis', 'wmav2', 'wmav1', 'opus', 'alac', 'mp4a')
  THEN round_even((bitrate // 1000) * 0.75, 0) ELSE 160 END)) / 8, 0) * 8 END AS BIGINT) AS target FROM technical_features""",
    "q65_conversion_plan": r"""SELECT metadata_id, regexp_replace(full_path, '\.[A-Za-z0-9]+$', '.opus') AS target,
  CASE WHEN lower(regexp_extract(full_path, '\.([A-Za-z0-9]+)$', 1)) = 'opus' THEN 'skipped_existing' WHEN codec IS NULL THEN 'missing_source' ELSE 'planned' END AS state,
  CAST(CASE WHEN lower(regexp_extract(full_path, '\.([A-Za-z0-9]+)$', 1)) IN ('flac', 'wav') THEN 0 WHEN lower(regexp_extract(full_path, '\.([A-Za-z0-9]+)$', 1)) IN ('m4a', 'ogg') THEN 1 ELSE 2 END AS BIGINT) AS priority
FROM tracks LEFT JOIN technical_features USING (metadata_id)""",
}
