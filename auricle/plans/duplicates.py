"""Duplicate detection, group assignment, pruning and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import text as txt
from auricle.io import load
from auricle.operators import dedup, prune, resolve, selection
from auricle.operators.malformed import length_in_seconds, size_in_bytes
from auricle.plans.library import BASE_SQL, LIB, grouped_library, library


def q10_hash_duplicates_full(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hash_groups(load(spark, d, "documents").where("text != ''"), "doc_id", F.sha2("text", 256))


def q11_hash_duplicates_partial(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").where("text != ''").select("doc_id", "text")
    return dedup.partial_groups(rows, "doc_id", F.sha2("text", 256), dedup.partial_key(F.col("text"), 40))


def q12_fuzzy_duplicates(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks").select("metadata_id", "artist", "title")
    tech = load(spark, d, "technical_features").select("metadata_id", "duration_ms")
    return dedup.fuzzy_duplicates(tracks.join(tech, "metadata_id", "left"))


def q13_remix_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.remix_groups(load(spark, d, "tracks"))


def q14_dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_library(spark, d).select("metadata_id", "duplicate_group", "remix_group")
    return selection.first_of_groups(rows, "metadata_id", "metadata_id", ["duplicate_group", "remix_group"]).select("metadata_id")


def q15_assign_groups(spark: SparkSession, d: str) -> DataFrame:
    """Full and partial digests of documents as groups, over old ids."""
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("metadata_id"), "text", F.col("source").alias("duplicate_group"), F.col("lang").alias("remix_group"))
    full_of, part_of = F.sha2("text", 256), dedup.partial_key(F.col("text"), 40)
    rows = docs.where("text != ''")
    full = rows.select("metadata_id", full_of.alias("digest")).join(dedup.hash_groups(rows, "metadata_id", full_of), "digest")
    part = rows.select("metadata_id", part_of.alias("digest")).join(dedup.partial_groups(rows, "metadata_id", full_of, part_of), "digest")
    part = part.join(full.select("metadata_id"), "metadata_id", "left_anti")
    none = spark.createDataFrame([], "metadata_id string, group_id string")
    named = lambda g: g.select("metadata_id", F.concat(F.lit("g"), "first").alias("group_id"))
    out = dedup.assign_groups(docs.drop("text"), named(full), named(part), none, none)
    return out.select("metadata_id", "duplicate_group", "remix_group")


def _technical(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "tracks").select("metadata_id", size_in_bytes(F.col("file_size")).alias("size"), length_in_seconds(F.col("length_seconds")).alias("seconds"))
    return library(spark, d).join(sizes, "metadata_id")


def q55_axe_list(spark: SparkSession, d: str) -> DataFrame:
    return prune.axe_list(_technical(spark, d))


def q51_match_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best classification of each primary genre at or above the threshold."""
    rows = load(spark, d, "ml_features").select("metadata_id", "genre_primary", "genre_confidence").where("genre_primary is not null")
    return resolve.match_rank(rows, "genre_primary", "genre_confidence", "metadata_id", 0.5)


def q52_tiered_best_match(spark: SparkSession, d: str) -> DataFrame:
    songs = load(spark, d, "indexedsong").select(F.col("song_id").alias("id"), "title", "artist")
    return resolve.tiered(songs, load(spark, d, "tracks"))


def q53_path_resolve(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks").select("metadata_id", "full_path")
    index = load(spark, d, "indexedsong").select(txt.canonical_path(F.col("path")).alias("path_key"), "song_id")
    ways = F.concat(txt.path_candidates(F.col("full_path"), "/srv/media/music", "Music"), txt.path_candidates(F.col("full_path"), "D:\\Tonlager", "Tonlager"))
    return resolve.by_first_key(tracks, "metadata_id", F.array_distinct(ways), index, "path_key", "song_id")


def q54_fuzzy_resolve(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks").select(
        F.col("metadata_id").alias("id"), txt.title_key(F.col("title")).alias("title_key"), txt.artist_keys(F.col("artist")).alias("artist_keys")
    )
    return resolve.best_fuzzy(tracks, load(spark, d, "indexedsong").select("song_id", "title_key", "artist_key"))


QUERIES = {
    f.__name__: f
    for f in (
        q10_hash_duplicates_full, q11_hash_duplicates_partial, q12_fuzzy_duplicates, q13_remix_groups, q14_dedup_candidates, q15_assign_groups,
        q51_match_rank, q52_tiered_best_match, q53_path_resolve, q54_fuzzy_resolve, q55_axe_list,
    )
}

_PART = "sha256(CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 40) || right(text, 40) END)"
_FULL_GROUPS = "f AS (SELECT sha256(text) AS digest, count(*) AS members, min(doc_id) AS first FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1)"
_PART_GROUPS = f"p AS (SELECT {_PART} AS digest, count(*) AS members, min(doc_id) AS first FROM documents WHERE text <> '' AND sha256(text) NOT IN (SELECT digest FROM f) GROUP BY 1 HAVING count(*) > 1)"
_FOLD = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
_CORE = rf"trim(regexp_replace(regexp_replace({_FOLD.format('title')}, '{txt.VERSION_TAG}', '', 'g'), '\s+', ' ', 'g'), ' -_')"
_LEN = r"^(\d+|\d+:[0-5]\d|\d+:[0-5]\d:[0-5]\d)$"
_SIZE = r"^(\d+|\d+(\.\d{1,2})? ?(KB|MB|GB))$"
_TECH = rf"""tech AS (SELECT lib.*, CASE WHEN regexp_matches(length_seconds, '{_LEN}') THEN
    list_reduce(list_transform(string_split(length_seconds, ':'), lambda p: CAST(p AS BIGINT)), lambda a, p: a * 60 + p) END AS seconds,
  CASE WHEN regexp_matches(file_size, '{_SIZE}') THEN CAST(floor(CAST(regexp_extract(file_size, '^([0-9.]+)', 1) AS DECIMAL(30,2)) *
    CASE regexp_extract(file_size, '(KB|MB|GB)$', 1) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END) AS BIGINT) END AS size
  FROM lib JOIN (SELECT metadata_id, length_seconds, file_size FROM tracks) USING (metadata_id))"""
_CANON = r"lower(regexp_replace(regexp_replace(trim(replace({0}, '\', '/')), '/+', '/', 'g'), '^/+|/+$', '', 'g'))"
_RANK = "CASE WHEN integrity_ok = 1 THEN 1 ELSE 0 END DESC, coalesce(bitrate, 0) DESC, coalesce(size, 0) DESC, metadata_id"

ORACLE = {
    "q10_hash_duplicates_full": f"WITH {_FULL_GROUPS} SELECT * FROM f",
    "q11_hash_duplicates_partial": f"WITH {_FULL_GROUPS}, {_PART_GROUPS} SELECT * FROM p",
    "q13_remix_groups": f"""SELECT * FROM (SELECT lower(trim(artist)) AS artist_key, {BASE_SQL} AS base_key, count(*) AS members, min(metadata_id) AS first
FROM tracks GROUP BY 1, 2 HAVING count(*) > 1) WHERE artist_key <> '' AND base_key <> ''""",
    "q14_dedup_candidates": f"""SELECT metadata_id FROM (SELECT metadata_id, lower(trim(artist)) AS ak, {BASE_SQL} AS rk FROM tracks)
QUALIFY row_number() OVER (PARTITION BY CASE WHEN ak <> '' AND rk <> '' THEN ak || '|' || rk ELSE '#' || metadata_id END ORDER BY metadata_id) = 1""",
    "q15_assign_groups": f"""WITH {_FULL_GROUPS}, {_PART_GROUPS}
SELECT CAST(doc_id AS VARCHAR) AS metadata_id, CASE WHEN f.digest IS NOT NULL THEN 'g' || (SELECT min(CAST(e.doc_id AS VARCHAR)) FROM documents e WHERE sha256(e.text) = f.digest)
  WHEN p.digest IS NOT NULL THEN 'g' || (SELECT min(CAST(e.doc_id AS VARCHAR)) FROM documents e WHERE e.text <> '' AND sha256(e.text) NOT IN (SELECT digest FROM f) AND {_PART.replace('text', 'e.text')} = p.digest)
  ELSE source END AS duplicate_group, lang AS remix_group
FROM documents d LEFT JOIN f ON d.text <> '' AND sha256(d.text) = f.digest LEFT JOIN p ON d.text <> '' AND f.digest IS NULL AND {_PART} = p.digest""",
    "q51_match_rank": """SELECT metadata_id, genre_primary, genre_confidence FROM ml_features WHERE genre_primary IS NOT NULL AND genre_confidence >= 0.5
QUALIFY row_number() OVER (PARTITION BY genre_primary ORDER BY genre_confidence DESC, metadata_id DESC) = 1""",
    "q52_tiered_best_match": """WITH t AS (SELECT lower(title) AS tk, coalesce(lower(artist), '') AS ak, min(metadata_id) AS metadata_id FROM tracks WHERE title <> '' GROUP BY 1, 2),
s AS (SELECT DISTINCT lower(title) AS p, coalesce(lower(artist), '') AS w FROM indexedsong WHERE title <> ''),
m AS (SELECT p, w, tk, ak, metadata_id, w <> '' AND contains(ak, w) AS named FROM s JOIN t ON contains(tk, p)),
b AS (SELECT *, CASE WHEN named AND tk = p AND ak = w THEN 0 WHEN named THEN 1 ELSE 2 END AS tier FROM m
QUALIFY row_number() OVER (PARTITION BY p, w ORDER BY CASE WHEN named AND tk = p AND ak = w THEN 0 WHEN named THEN 1 ELSE 2 END, CASE WHEN tk = p THEN 0 ELSE 1 END, CASE WHEN named AND ak = w THEN 0 ELSE 1 END, metadata_id) = 1)
SELECT song_id AS id, metadata_id, CASE WHEN tier = 0 THEN 'exact' ELSE 'fuzzy' END AS confidence FROM indexedsong JOIN b ON lower(title) = p AND coalesce(lower(artist), '') = w""",
    "q53_path_resolve": rf"""WITH f AS (SELECT metadata_id, full_path, lower(regexp_replace(replace(full_path, '\', '/'), '/+$', '')) AS p FROM tracks),
r AS (SELECT *, CASE WHEN starts_with(p, '/srv/media/music/') THEN substr(p, 18) WHEN regexp_matches(p, '^[a-z]:/') THEN NULL ELSE regexp_replace(p, '^/+', '') END AS a,
  CASE WHEN starts_with(p, 'd:/tonlager/') THEN substr(p, 13) WHEN regexp_matches(p, '^[a-z]:/') THEN NULL ELSE regexp_replace(p, '^/+', '') END AS b FROM f),
k AS (SELECT metadata_id, unnest([{_CANON.format("'music/' || a")}, {_CANON.format('a')}, {_CANON.format('p')}, {_CANON.format("'tonlager/' || b")}, {_CANON.format('b')}, {_CANON.format('p')}]) AS k,
  unnest([1, 2, 3, 4, 5, 6]) AS tried FROM r)
SELECT metadata_id, song_id FROM k JOIN (SELECT {_CANON.format('path')} AS path_key, song_id FROM indexedsong) ON k = path_key
QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY tried, song_id) = 1""",
    "q55_axe_list": f"""WITH {LIB}, {_TECH},
a AS (SELECT metadata_id, 'safe_auto' AS tier, 'exact_duplicate_artist_title' AS reason, 0 AS level FROM tech WHERE {_FOLD.format('artist')} <> '' AND {_FOLD.format('title')} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_FOLD.format('artist')}, {_FOLD.format('title')} ORDER BY {_RANK}) > 1),
b AS (SELECT metadata_id, 'review_fast' AS tier, list_aggregate(list_filter([CASE WHEN seconds < 48 THEN 'very_short_lt48s' END,
    CASE WHEN integrity_ok = 0 AND bitrate > 0 AND bitrate < 160000 THEN 'integrity_bad_and_low_bitrate' END,
    CASE WHEN lowpass_cutoff_hz < 16000 AND bitrate > 0 AND bitrate <= 192000 THEN 'suspected_lowpass_transcode' END,
    CASE WHEN silence_ratio >= 0.35 THEN 'silence_heavy' END, CASE WHEN clipping_ratio >= 0.01 THEN 'clipping_detected' END], lambda x: x IS NOT NULL), 'string_agg', '|') AS reason, 1 AS level FROM tech),
c AS (SELECT metadata_id, 'review_curate' AS tier, 'remix_family_overflow_keep2' AS reason, 2 AS level FROM tech WHERE {_FOLD.format('artist')} <> '' AND {_CORE} <> ''
  QUALIFY row_number() OVER (PARTITION BY {_FOLD.format('artist')}, {_CORE} ORDER BY {_RANK}) > 2)
SELECT metadata_id, tier, reason FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE reason <> '' UNION ALL SELECT * FROM c)
QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY level) = 1""",
}
