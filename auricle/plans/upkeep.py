"""Lists, exports, diagnostics and audio measures over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import audio, features
from auricle.io import load
from auricle.operators import lists
from auricle.plans.library import LIB, library
from auricle.plans.playlists import _MEMBERS, members


def all_lists(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("list_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"))


def q67_list_overview(spark: SparkSession, d: str) -> DataFrame:
    few = members(spark, d).where("position > 3")
    return lists.overview(all_lists(spark, d).select("list_id"), few)


def q68_resolve_list(spark: SparkSession, d: str) -> DataFrame:
    return lists.resolve_list(all_lists(spark, d), "2-HIGH").select("list_id", "name")


def q69_outside_folders(spark: SparkSession, d: str) -> DataFrame:
    return lists.outside(load(spark, d, "tracks").select("metadata_id", "full_path"), "full_path", ["D:\\Tonlager\\Vinyl Rips", "/srv/media/"]).select("metadata_id")


def q70_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "tracks").where("artist is not null and title is not null").select(
        "metadata_id", F.concat(F.lit("track:"), F.lower("artist"), F.lit(":"), F.lower("title")).alias("key")
    )
    return keys.select("metadata_id", lists.cache_key("track", F.col("key")).alias("k")).select("metadata_id", "k.artist", "k.title")


def q71_writeback_tags(spark: SparkSession, d: str) -> DataFrame:
    stats = load(spark, d, "artist_stats").where("genres is not null and genres != ''").select("metadata_id", F.col("id").alias("seq"), F.col("genres").alias("genre"))
    return lists.writeback_tags(library(spark, d), stats)


def q72_append_items(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest part goes to the end of every list."""
    rows = members(spark, d)
    first = load(spark, d, "part").agg(F.min("p_partkey")).first()[0]
    return lists.append(rows, rows.select("list_id").distinct().withColumn("item_id", F.lit(first).cast("long")))


def q73_curated_summary(spark: SparkSession, d: str) -> DataFrame:
    r = library(spark, d).where("genre_primary is not null")
    return r.groupBy("genre_primary").agg(
        F.count("*").alias("tracks"), F.min("bpm").alias("bpm_min"), F.max("bpm").alias("bpm_max"), F.countDistinct("camelot_key").alias("keys"), F.sum(F.coalesce("listeners", F.lit(0))).alias("listeners")
    )


def q74_spectrum(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", audio.spectrum(64.0)(F.col("embedding")).alias("s"))
    return e.select("vec_id", *[F.round(f"s.{n}", 6).alias(n) for n in audio.SPECTRUM.names])


def q75_key_of_chroma(spark: SparkSession, d: str) -> DataFrame:
    chroma = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    e = load(spark, d, "embeddings").select("vec_id", audio.key_of(chroma).alias("k"))
    return e.select("vec_id", "k.key", "k.mode", features.camelot(F.col("k.key"), F.col("k.mode")).alias("camelot"))


def q76_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", audio.quality_flags(F.col("embedding").cast("array<double>")).alias("q"))
    return e.select("vec_id", F.round("q.clipping", 6).alias("clipping"), F.round("q.silence", 6).alias("silence"))


def q77_path_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose fields look shifted or whose path has no known root, by reason."""
    t = load(spark, d, "tracks")
    why = features.labels(
        [
            (F.col("file_path").rlike(r"^\d.{0,9}/"), "date_as_path"),
            (F.col("file_path").endswith(" MB"), "size_as_path"),
            (~F.col("full_path").rlike(r"^([A-Za-z]:\\|/)"), "no_root"),
            (F.col("file_size").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "date_as_size"),
            (F.col("length_seconds").rlike(r"(MB|KB)$"), "size_as_length"),
        ]
    )
    return t.select("metadata_id", F.array_join(why, ",").alias("reasons")).where("reasons != ''")


def q78_source_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Statistics rows per source and their distinct tracks, as an audit of repeated fetches."""
    return load(spark, d, "artist_stats").groupBy("source").agg(
        F.count("*").alias("fetched"), F.countDistinct("metadata_id").alias("tracks"), (F.count("*") - F.countDistinct("metadata_id")).alias("repeats")
    )


QUERIES = {
    f.__name__: f
    for f in (
        q67_list_overview, q68_resolve_list, q69_outside_folders, q70_cache_keys, q71_writeback_tags, q72_append_items, q73_curated_summary, q74_spectrum,
        q75_key_of_chroma, q76_quality_flags, q77_path_checks, q78_source_pivot,
    )
}

ORACLE = {
    "q67_list_overview": f"WITH {_MEMBERS} SELECT o_orderkey AS list_id, count(position) AS members FROM orders LEFT JOIN (SELECT * FROM members WHERE position > 3) ON list_id = o_orderkey GROUP BY 1",
    "q68_resolve_list": "SELECT o_orderkey AS list_id, o_orderpriority AS name FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1",
    "q69_outside_folders": r"""SELECT metadata_id FROM (SELECT metadata_id, lower(regexp_replace(regexp_replace(trim(replace(full_path, '\', '/')), '/+', '/', 'g'), '^/+|/+$', '', 'g')) AS p FROM tracks)
WHERE NOT coalesce(p = 'd:/tonlager/vinyl rips' OR starts_with(p, 'd:/tonlager/vinyl rips/') OR p = 'srv/media' OR starts_with(p, 'srv/media/'), false)""",
    "q70_cache_keys": """SELECT metadata_id, regexp_extract(key, '^track:(.*):([^:]*)$', 1) AS artist, regexp_extract(key, '^track:(.*):([^:]*)$', 2) AS title
FROM (SELECT metadata_id, 'track:' || lower(artist) || ':' || lower(title) AS key FROM tracks WHERE artist IS NOT NULL AND title IS NOT NULL)""",
    "q71_writeback_tags": f"""WITH {LIB} SELECT metadata_id, CAST(CAST(round_even(bpm, 0) AS INTEGER) AS VARCHAR) AS bpm_tag, camelot_key AS key_tag, genre_tag
FROM lib LEFT JOIN (SELECT metadata_id, arg_min(genres, id) AS genre_tag FROM artist_stats WHERE genres <> '' GROUP BY 1) USING (metadata_id)""",
    "q72_append_items": f"""WITH {_MEMBERS}, p AS (SELECT min(p_partkey) AS item_id FROM part), l AS (SELECT list_id, max(position) AS last FROM members GROUP BY 1)
SELECT list_id, item_id, CAST(position AS BIGINT) AS position FROM members UNION ALL SELECT l.list_id, p.item_id, CAST(last + 1 AS BIGINT) FROM l, p
WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.list_id = l.list_id AND m.item_id = p.item_id)""",
    "q73_curated_summary": f"""WITH {LIB} SELECT genre_primary, count(*) AS tracks, min(bpm) AS bpm_min, max(bpm) AS bpm_max, count(DISTINCT camelot_key) AS keys,
  CAST(sum(coalesce(listeners, 0)) AS BIGINT) AS listeners FROM lib WHERE genre_primary IS NOT NULL GROUP BY 1""",
    "q76_quality_flags": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS l FROM embeddings)
SELECT vec_id, round(len(list_filter(l, lambda x: x >= 0.999::DOUBLE)) / len(l), 6) AS clipping, round(len(list_filter(l, lambda x: x <= list_max(l) * 0.05::DOUBLE)) / len(l), 6) AS silence FROM v""",
    "q77_path_checks": r"""SELECT metadata_id, reasons FROM (SELECT metadata_id, array_to_string(list_filter([CASE WHEN regexp_matches(file_path, '^\d.{0,9}/') THEN 'date_as_path' END,
  CASE WHEN ends_with(file_path, ' MB') THEN 'size_as_path' END, CASE WHEN NOT regexp_matches(full_path, '^([A-Za-z]:\\|/)') THEN 'no_root' END,
  CASE WHEN regexp_matches(file_size, '^\d{1,2}/\d{1,2}/\d{4}$') THEN 'date_as_size' END, CASE WHEN regexp_matches(length_seconds, '(MB|KB)$') THEN 'size_as_length' END], lambda x: x IS NOT NULL), ',') AS reasons FROM tracks)
WHERE reasons <> ''""",
    "q78_source_pivot": "SELECT source, count(*) AS fetched, count(DISTINCT metadata_id) AS tracks, count(*) - count(DISTINCT metadata_id) AS repeats FROM artist_stats GROUP BY 1",
}
