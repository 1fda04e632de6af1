"""Job states, gaps, merges, search and detail views. Orders stand for jobs (priority as stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import features
from auricle.functions.coerce import blank
from auricle.io import load
from auricle.operators import merge, search
from auricle.plans.library import LIB, library, popularity
from auricle.sources import records

STATUS = {"F": "done", "O": "pending", "P": "failed"}


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("stage"), status[F.col("o_orderstatus")].alias("status"),
        (F.col("o_orderkey") % 4).alias("attempts"), F.col("o_custkey").alias("metadata_id"),
    )


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS stage, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status,
  o_orderkey % 4 AS attempts, o_custkey AS metadata_id FROM orders)"""


def q16_job_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("stage", "status").agg(F.count("*").alias("n"))


def q17_job_pivot(spark: SparkSession, d: str) -> DataFrame:
    counted = jobs(spark, d).groupBy("stage")
    return counted.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "done", "failed")])


def q18_pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    done, total = F.count_if(F.col("status") == "done"), F.count("*")
    return jobs(spark, d).agg(
        total.alias("total"), done.alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.round(F.when(total > 0, done / total * 100).otherwise(0.0), 6).alias("completion"),
    )


def q19_enrich_gap_finder(spark: SparkSession, d: str) -> DataFrame:
    """Tracks that lack a technical, classification or statistics row, or a filled album or year, with the gaps named."""
    tracks = load(spark, d, "tracks").select("metadata_id", "album", "year")
    for name in ("technical_features", "ml_features"):
        tracks = tracks.join(load(spark, d, name).select("metadata_id", F.lit(1).alias(name)), "metadata_id", "left")
    stats = load(spark, d, "artist_stats").groupBy("metadata_id", "source").agg(F.count("*").alias("n"))
    for source in ("lastfm", "musicbrainz"):
        tracks = tracks.join(stats.where(F.col("source") == source).select("metadata_id", F.col("n").alias(source)), "metadata_id", "left")
    gaps = features.labels(
        [(F.col(c).isNull(), c) for c in ("technical_features", "ml_features", "lastfm", "musicbrainz")] + [(blank(F.col(c)), c) for c in ("album", "year")]
    )
    return tracks.select("metadata_id", F.array_join(gaps, ",").alias("gaps")).where("gaps != ''")


def q20_retry_failed(spark: SparkSession, d: str) -> DataFrame:
    return merge.retry_failed(jobs(spark, d), "1-URGENT", 3)


def q21_claim_pending_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pending jobs of subjects that have no failed job."""
    rows = jobs(spark, d)
    failed = rows.where("status = 'failed'").select("metadata_id").distinct()
    return rows.where("status = 'pending'").join(failed, "metadata_id", "left_anti").select("job_id", "stage")


def q22_lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Last event of each user; those older than an hour before the newest event have expired."""
    events = load(spark, d, "events").select("user_id", "ts", "event_id")
    newest = events.agg(F.max("ts")).first()[0]
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return last.where(F.col("ts") < F.lit(newest) - F.expr("interval 3600 seconds"))


def q23_track_search_page(spark: SparkSession, d: str) -> DataFrame:
    return search.page(library(spark, d), "river", {"vocal_type": None}, "artist", 2).select("metadata_id", "artist", "title")


def q24_facet_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = library(spark, d).select("genre_primary", "vocal_type", "camelot_key")
    facets = [search.facet(rows, c).select(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in rows.columns]
    return facets[0].union(facets[1]).union(facets[2])


def q25_page_count(spark: SparkSession, d: str) -> DataFrame:
    return search.page_count(load(spark, d, "tracks").where(search.contains("river", ["title", "artist", "album"])))


def q26_track_detail_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One row per track with the newest counts of each source side by side."""
    stats = load(spark, d, "artist_stats")
    newest = stats.groupBy("metadata_id", "source").agg(
        F.max_by(F.struct("listeners", "play_count", "country"), F.struct("fetched_at", "id")).alias("s")
    )
    pick = lambda source, c: F.max(F.when(F.col("source") == source, F.col(f"s.{c}")))
    return newest.groupBy("metadata_id").agg(
        pick("lastfm", "listeners").alias("lastfm_listeners"), pick("lastfm", "play_count").alias("lastfm_plays"), pick("musicbrainz", "country").alias("country")
    )


def q30_export_flat(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).select(
        "metadata_id", "title", "artist", "album", F.col("bpm").alias("bpm_final"), F.col("camelot_key").alias("key"), "energy", "genre_primary", "listeners"
    )


def q31_track_candidates_anti(spark: SparkSession, d: str) -> DataFrame:
    """Tracks with a word in the title that no statistics row knows."""
    known = load(spark, d, "artist_stats").select("metadata_id").distinct()
    rows = load(spark, d, "tracks").where(search.contains("echo", ["title"]))
    return rows.join(known, "metadata_id", "left_anti").select("metadata_id", "title")


def _old_and_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as the old state; the newest order of each customer as the update."""
    old = load(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name", F.lit(None).cast("string").alias("last_order"), "c_mktsegment")
    order = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey"))
    new = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(order.alias("last_order"))
    return old, new


def q35_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return merge.upsert(old, new, ["c_custkey"], ["last_order"])


def q36_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_and_new(spark, d)
    return merge.insert_ignore(old, new, ["c_custkey"], [F.col("last_order")])


def q37_fill_if_empty(spark: SparkSession, d: str) -> DataFrame:
    """Empty albums and years are filled from the smallest filled value of the act."""
    tracks = load(spark, d, "tracks").select("metadata_id", "artist", "album", "year")
    filled = lambda c: F.min(F.when(~blank(F.col(c)), F.col(c))).alias(c)
    of_act = tracks.where(~blank(F.col("artist"))).groupBy("artist").agg(filled("album"), filled("year"))
    return merge.fill_if_empty(tracks, of_act, ["artist"], ["album", "year"])


def q38_derive_signals(spark: SparkSession, d: str) -> DataFrame:
    """One row per track, also without features."""
    r = library(spark, d)
    return r.select(
        "metadata_id",
        features.decade(F.col("year")).alias("decade"),
        features.year_bucket(F.col("year")).alias("year_bucket"),
        features.bpm_bucket(F.col("bpm")).alias("bpm_bucket"),
        features.energy_tier(F.col("energy")).alias("energy_tier"),
        features.popularity_tier(F.col("listeners")).alias("popularity_tier"),
    )


def q49_json_payload_parse(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return events


def q50_tags_explode(spark: SparkSession, d: str) -> DataFrame:
    """Acts that JSON lists name as similar, counted."""
    names = load(spark, d, "artist_stats").select(F.explode(F.from_json("similar_artists", "array<string>")).alias("name"))
    return names.where("name != ''").groupBy("name").agg(F.count("*").alias("n"))


def q61_error_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct first 50 characters of integrity messages per codec."""
    rows = load(spark, d, "technical_features").where("integrity_errors is not null")
    return rows.groupBy("codec").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.substr("integrity_errors", F.lit(1), F.lit(50)))), ";").alias("errors"))


def q62_tag_top10(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "tracks").where("genre is not null and genre != ''").groupBy("genre").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "genre").limit(10)


def q66_payload_sources(spark: SparkSession, d: str) -> DataFrame:
    """Statistics written as a service's payload and read back through its parser."""
    stats = load(spark, d, "artist_stats").where("source = 'lastfm'")
    payload = F.to_json(F.struct(F.struct(F.struct(F.col("listeners").cast("string").alias("listeners"), F.col("play_count").cast("string").alias("playcount")).alias("stats")).alias("artist")))
    parsed = stats.select("id", records.lastfm_artist(payload).alias("p"))
    return parsed.select("id", "p.listeners", "p.play_count")


QUERIES = {
    f.__name__: f
    for f in (
        q16_job_counts, q17_job_pivot, q18_pipeline_stats, q19_enrich_gap_finder, q20_retry_failed, q21_claim_pending_anti, q22_lease_expiry,
        q23_track_search_page, q24_facet_distinct, q25_page_count, q26_track_detail_pivot, q30_export_flat, q31_track_candidates_anti, q35_upsert_merge,
        q36_insert_ignore, q37_fill_if_empty, q38_derive_signals, q49_json_payload_parse, q50_tags_explode, q61_error_rollup, q62_tag_top10, q66_payload_sources,
    )
}

_OLD_NEW = """old AS (SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS last_order, c_mktsegment FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1)"""

ORACLE = {
    "q16_job_counts": f"WITH {_JOBS} SELECT stage, status, count(*) AS n FROM jobs GROUP BY 1, 2",
    "q17_job_pivot": f"WITH {_JOBS} SELECT stage, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM jobs GROUP BY 1",
    "q18_pipeline_stats": f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, round(count(*) FILTER (status = 'done') / count(*) * 100, 6) AS completion FROM jobs",
    "q19_enrich_gap_finder": """SELECT metadata_id, gaps FROM (SELECT t.metadata_id, list_aggregate(list_filter([
  CASE WHEN x.metadata_id IS NULL THEN 'technical_features' END, CASE WHEN m.metadata_id IS NULL THEN 'ml_features' END,
  CASE WHEN l.metadata_id IS NULL THEN 'lastfm' END, CASE WHEN b.metadata_id IS NULL THEN 'musicbrainz' END,
  CASE WHEN album IS NULL OR album = '' THEN 'album' END, CASE WHEN year IS NULL OR year = '' THEN 'year' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS gaps
FROM tracks t LEFT JOIN technical_features x USING (metadata_id) LEFT JOIN ml_features m USING (metadata_id)
LEFT JOIN (SELECT DISTINCT metadata_id FROM artist_stats WHERE source = 'lastfm') l USING (metadata_id)
LEFT JOIN (SELECT DISTINCT metadata_id FROM artist_stats WHERE source = 'musicbrainz') b USING (metadata_id)) WHERE gaps <> ''""",
    "q20_retry_failed": f"WITH {_JOBS} SELECT job_id, stage, CASE WHEN status = 'failed' AND stage = '1-URGENT' AND attempts < 3 THEN 'pending' ELSE status END AS status, attempts, metadata_id FROM jobs",
    "q21_claim_pending_anti": f"WITH {_JOBS} SELECT job_id, stage FROM jobs WHERE status = 'pending' AND metadata_id NOT IN (SELECT metadata_id FROM jobs WHERE status = 'failed')",
    "q22_lease_expiry": "SELECT user_id, ts FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3600 SECONDS",
    "q23_track_search_page": """SELECT metadata_id, artist, title FROM tracks WHERE title ILIKE '%river%' OR artist ILIKE '%river%' OR album ILIKE '%river%'
ORDER BY CASE WHEN artist IS NULL OR artist = '' THEN 1 ELSE 0 END, artist COLLATE "binary" NULLS FIRST, metadata_id LIMIT 50 OFFSET 50""",
    "q24_facet_distinct": f"""WITH {LIB} SELECT DISTINCT 'genre_primary' AS facet, genre_primary AS value FROM lib WHERE genre_primary IS NOT NULL
UNION ALL SELECT DISTINCT 'vocal_type', vocal_type FROM lib WHERE vocal_type IS NOT NULL UNION ALL SELECT DISTINCT 'camelot_key', camelot_key FROM lib WHERE camelot_key IS NOT NULL""",
    "q25_page_count": "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM tracks WHERE title ILIKE '%river%' OR artist ILIKE '%river%' OR album ILIKE '%river%'",
    "q26_track_detail_pivot": """WITH n AS (SELECT * FROM artist_stats QUALIFY row_number() OVER (PARTITION BY metadata_id, source ORDER BY fetched_at DESC, id DESC) = 1)
SELECT metadata_id, max(listeners) FILTER (source = 'lastfm') AS lastfm_listeners, max(play_count) FILTER (source = 'lastfm') AS lastfm_plays, max(country) FILTER (source = 'musicbrainz') AS country FROM n GROUP BY 1""",
    "q30_export_flat": f"WITH {LIB} SELECT metadata_id, title, artist, album, bpm AS bpm_final, camelot_key AS key, energy, genre_primary, listeners FROM lib",
    "q31_track_candidates_anti": "SELECT metadata_id, title FROM tracks t WHERE title ILIKE '%echo%' AND NOT EXISTS (SELECT 1 FROM artist_stats s WHERE s.metadata_id = t.metadata_id)",
    "q35_upsert_merge": f"WITH {_OLD_NEW} SELECT c_custkey, c_name, coalesce(new.last_order, old.last_order) AS last_order, c_mktsegment FROM old FULL JOIN new USING (c_custkey)",
    "q36_insert_ignore": f"WITH {_OLD_NEW} SELECT * FROM old UNION ALL SELECT c_custkey, NULL, last_order, NULL FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)",
    "q37_fill_if_empty": """WITH f AS (SELECT artist, min(album) FILTER (album <> '') AS a, min(year) FILTER (year <> '') AS y FROM tracks WHERE artist <> '' GROUP BY 1)
SELECT metadata_id, artist, CASE WHEN album IS NULL OR album = '' THEN coalesce(a, album) ELSE album END AS album, CASE WHEN year IS NULL OR year = '' THEN coalesce(y, year) ELSE year END AS year
FROM tracks LEFT JOIN f USING (artist)""",
    "q38_derive_signals": f"""WITH {LIB} SELECT metadata_id, CAST(CAST(floor(try_cast(substr(year, 1, 4) AS INTEGER) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' AS decade,
  CASE WHEN length(year) >= 4 THEN substr(year, 1, 4) END AS year_bucket,
  CASE WHEN bpm < 100 THEN 'slow' WHEN bpm < 120 THEN 'mid' WHEN bpm < 150 THEN 'fast' WHEN bpm IS NOT NULL THEN 'very_fast' END AS bpm_bucket,
  CASE WHEN energy < 0.33 THEN 'low' WHEN energy < 0.66 THEN 'medium' WHEN energy IS NOT NULL THEN 'high' END AS energy_tier,
  CASE WHEN listeners < 1000 THEN 'niche' WHEN listeners < 100000 THEN 'mainstream' WHEN listeners IS NOT NULL THEN 'viral' ELSE 'unknown' END AS popularity_tier FROM lib""",
    "q49_json_payload_parse": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "q50_tags_explode": "SELECT name, count(*) AS n FROM (SELECT unnest(from_json(similar_artists, '[\"VARCHAR\"]')) AS name FROM artist_stats WHERE similar_artists IS NOT NULL) WHERE name <> '' GROUP BY 1",
    "q61_error_rollup": "SELECT codec, count(*) AS n, string_agg(DISTINCT substr(integrity_errors, 1, 50), ';' ORDER BY substr(integrity_errors, 1, 50)) AS errors FROM technical_features WHERE integrity_errors IS NOT NULL GROUP BY 1",
    "q62_tag_top10": "SELECT genre, count(*) AS n FROM tracks WHERE genre <> '' GROUP BY 1 ORDER BY n DESC, genre LIMIT 10",
    "q66_payload_sources": "SELECT id, coalesce(listeners, 0) AS listeners, coalesce(play_count, 0) AS play_count FROM artist_stats WHERE source = 'lastfm'",
}
