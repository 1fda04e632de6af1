"""Enrichment, imports, the song index, conversions and detail views over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.functions.coerce import json_list
from auricle.io import load, materialize
from auricle.operators import conversion, enrichment, intake, lists, merge
from auricle.plans.library import LIB, library
from auricle.plans.playlists import _MEMBERS, members
from auricle.plans.states import _JOBS, jobs

c = F.col


def _newest(spark: SparkSession, d: str, source: str) -> DataFrame:
    """The newest statistics row of each track of one source."""
    rows = load(spark, d, "artist_stats").where(c("source") == source)
    return rows.groupBy("metadata_id").agg(F.max_by(F.struct("id", "listeners", "play_count", "active_years", "country", "disambiguation"), F.struct("fetched_at", "id")).alias("s")).select("metadata_id", "s.*")


_NEWEST = """lfm AS (SELECT * FROM artist_stats WHERE source = 'lastfm' QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY fetched_at DESC, id DESC) = 1),
mb AS (SELECT * FROM artist_stats WHERE source = 'musicbrainz' QUALIFY row_number() OVER (PARTITION BY metadata_id ORDER BY fetched_at DESC, id DESC) = 1)"""


def _lastfm(spark: SparkSession, d: str) -> DataFrame:
    tag = F.struct(c("country").alias("name"), (c("id") % 3 * 10).cast("int").alias("count"))
    return _newest(spark, d, "lastfm").select("metadata_id", (c("listeners") * 1000).alias("duration_ms"), F.when(c("id") % 2 == 0, F.concat(F.lit("L "), "country")).alias("album"), F.filter(F.array(tag), lambda t: t["name"].isNotNull()).alias("tags"))


def _recording(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _newest(spark, d, "musicbrainz").select(
        "metadata_id", F.concat(F.lit("rec-"), c("id").cast("string")).alias("recording_id"), F.when(c("id") % 2 == 0, F.concat(F.lit("act-"), "metadata_id")).otherwise(none).alias("artist_id"),
        F.array(F.concat(F.lit("ISRC"), c("id").cast("string"))).alias("isrcs"), F.array(c("country")).alias("tags"), c("active_years").alias("date"), F.concat(F.lit("M "), c("id").cast("string")).alias("album"),
    )


def _artist(spark: SparkSession, d: str) -> DataFrame:
    return _newest(spark, d, "musicbrainz").select("metadata_id", F.concat(F.lit("act-"), "metadata_id").alias("artist_id"), F.array("disambiguation").alias("tags"), F.lit(None).cast("string").alias("active_years"), F.upper("country").alias("country"))


def q97_enrich_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tracks").select("metadata_id", "album", "year", "length_seconds")
    return enrichment.fill_tracks(t, _lastfm(spark, d), _recording(spark, d))


def q98_enrich_tags(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "ml_features").where("genre_primary is not null").select("metadata_id", F.when(c("danceability") > 0.5, "lastfm").otherwise("musicbrainz").alias("source"), c("genre_primary").alias("tag"), c("genre_confidence").alias("confidence"))
    artist_tags = _newest(spark, d, "lastfm").select("metadata_id", F.array("disambiguation").alias("tags"))
    return enrichment.merge_tags(old, _lastfm(spark, d), artist_tags, _recording(spark, d), _artist(spark, d))


def q99_enrich_ids(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "ml_features").select("metadata_id", F.lit("musicbrainz_artist").alias("source"), F.concat(F.lit("act-"), "metadata_id").alias("external_id"), F.lit(0.5).alias("confidence"))
    asked = enrichment.without_embedded(_recording(spark, d), load(spark, d, "technical_features").where("channels = 1").select("metadata_id", F.lit("musicbrainz").alias("source")))
    return enrichment.merge_ids(old, asked, _artist(spark, d))


def q100_artist_updates(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue values of acts, where the answer has them."""
    return enrichment.merge_artist_stats(load(spark, d, "artist_stats"), _artist(spark, d)).select("id", "source", "country", "active_years")


def q101_match_ids(spark: SparkSession, d: str) -> DataFrame:
    """Classifications stand for hits; a quarter of the tracks has no fingerprint."""
    m = load(spark, d, "ml_features").where("genre_primary is not null")
    hits = m.select("metadata_id", c("genre_confidence").alias("score"), c("genre_primary").alias("recording_id")).unionByName(m.where("genre_secondary is not null").select("metadata_id", (c("genre_confidence") * 0.8).alias("score"), c("genre_secondary").alias("recording_id")))
    prints = load(spark, d, "technical_features").select("metadata_id", F.when(c("sample_rate") % 4 != 1, F.repeat(F.concat(F.lit("print"), "metadata_id"), 3)).alias("fingerprint"))
    old = m.where("genre_confidence > 0.9").select("metadata_id", F.lit("musicbrainz").alias("source"), c("genre_primary").alias("external_id"), F.lit(1.0).alias("confidence"))
    out = enrichment.match_ids(hits, prints, old)
    return out.withColumn("confidence", F.round("confidence", 6))


def _songs_as_files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "indexedsong").select(c("song_id").alias("metadata_id"), "title", "artist", F.concat(F.lit("/srv/media/"), "path").alias("full_path"))


def q102_import_tracks(spark: SparkSession, d: str) -> DataFrame:
    return intake.import_tracks(_songs_as_files(spark, d), load(spark, d, "tracks"))[0]


def q103_seeded_jobs(spark: SparkSession, d: str) -> DataFrame:
    return intake.import_tracks(_songs_as_files(spark, d), load(spark, d, "tracks"))[1]


def q104_first_of_files(spark: SparkSession, d: str) -> DataFrame:
    """One row per folder and year, the first by id."""
    t = load(spark, d, "tracks").select("metadata_id", c("file_path").alias("path"), c("year").alias("filename"))
    return intake.first_of_files(t, c("metadata_id"))


def q105_song_paths(spark: SparkSession, d: str) -> DataFrame:
    return intake.song_paths(load(spark, d, "indexedsong"))


def q106_crawled_songs(spark: SparkSession, d: str) -> DataFrame:
    """Every song on a page of its own and twice in a list on another page, each of which counts once."""
    s = load(spark, d, "indexedsong").withColumn("song", F.struct(c("song_id").alias("id"), "title", "artist", "album", "path"))
    single = s.select(F.to_json(F.struct("song")).alias("body"))
    return intake.crawled(single.unionByName(s.select(F.to_json(F.struct(F.array("song", "song").alias("song"))).alias("body"))), "body")


def q107_service_items(spark: SparkSession, d: str) -> DataFrame:
    """Lists as pages of three items, every fifth item absent."""
    m = members(spark, d).withColumn("page", F.floor((c("position") - 1) / 3))
    name = lambda x: F.struct(F.concat(F.lit(x), c("item_id").cast("string")).alias("name"))
    track = F.struct(c("item_id").cast("string").alias("id"), F.concat(F.lit("T"), c("item_id").cast("string")).alias("name"), (c("item_id") * 1000).alias("duration_ms"), name("B").alias("album"), F.array(name("A"), name("Z")).alias("artists"))
    item = F.struct(c("position").alias("p"), F.when(c("item_id") % 5 != 0, track).alias("track"))
    pages = m.groupBy("list_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.to_json(F.struct(F.transform("items", lambda i: F.struct(i["track"].alias("track"))).alias("items")), {"ignoreNullFields": "false"})
    out = intake.service_items(pages.select("list_id", "page", body.alias("body")), "list_id", "page", "body")
    return out.withColumn("position", c("position").cast("long"))


def _confirmed(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("list_id", F.when(c("item_id") % 7 != 0, c("position")).alias("place"), F.when(c("item_id") % 11 != 0, c("item_id").cast("string")).alias("metadata_id"))


def q108_import_members(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "part").where("p_size > 10").select(c("p_partkey").cast("string").alias("metadata_id"))
    return intake.create_import(_confirmed(spark, d), known)[0]


def q109_import_counts(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "part").where("p_size > 10").select(c("p_partkey").cast("string").alias("metadata_id"))
    return intake.create_import(_confirmed(spark, d), known)[1]


def q110_conversion_states(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of conversions, from technical columns that stand for what the steps report."""
    t = load(spark, d, "technical_features")
    code = F.when(c("integrity_ok") == 0, 1).when(c("integrity_ok") == 1, 0)
    size = F.when(c("sample_rate") != 48000, c("duration_ms"))
    s = conversion.state(c("bitrate"), F.when(c("channels") == 1, 1).otherwise(0), code, size, F.coalesce(c("clipping_ratio") < 0.01, F.lit(True)))
    return t.select("metadata_id", s.alias("s")).select("metadata_id", "s.status", "s.error")


def q111_profiles(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("codec_name="), F.coalesce("codec", F.lit("")), F.lit("\nbit_rate="), F.coalesce(c("bitrate").cast("string"), F.lit("N/A")))
    return load(spark, d, "technical_features").select("metadata_id", conversion.profile(text).alias("p")).select("metadata_id", "p.codec", "p.kbps")


def q112_sibling_sources(spark: SparkSession, d: str) -> DataFrame:
    """Files of the library and of the index by one name; compressed ones find the original they were made from."""
    t = load(spark, d, "tracks").select(F.lower("full_path").alias("path"))
    return conversion.sibling_sources(t.unionByName(t.select(F.regexp_replace("path", r"\.[a-z0-9]+$", ".opus").alias("path"))).distinct(), "opus")


def q113_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Tracks whose name exists as a converted file; every third one does."""
    t = load(spark, d, "tracks").select("metadata_id", "full_path", "year")
    made = t.where("year like '%5'").select(F.regexp_replace("full_path", r"\.[A-Za-z0-9]+$", ".opus").alias("path"))
    return conversion.reconcile(t, made, "opus")


def q114_moves(spark: SparkSession, d: str) -> DataFrame:
    return conversion.moves(load(spark, d, "tracks"), "/srv/media")


def q115_relocate(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tracks").select("metadata_id", "file_path", "filename", "full_path")
    return conversion.relocate(t, t.where("full_path like 'D:%'").select("metadata_id", F.replace("full_path", F.lit("D:"), F.lit("E:")).alias("path")))


def q116_writeback_audit(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "tracks").select("metadata_id", F.lit(None).cast("string").alias("bpm_tag"), c("genre").alias("genre_tag"), F.lit("1A").alias("key_tag"))
    stats = load(spark, d, "ml_features").where("genre_primary is not null").select("metadata_id", F.lit(1).alias("seq"), c("genre_primary").alias("genre"))
    return conversion.writeback_audit(old, lists.writeback_tags(library(spark, d), stats), ["bpm_tag", "genre_tag", "key_tag"])


def q117_inventory(spark: SparkSession, d: str) -> DataFrame:
    side = load(spark, d, "technical_features").where("integrity_ok = 1").select("metadata_id", F.concat("metadata_id", F.lit(".json")).alias("sidecar_path"))
    return conversion.inventory(load(spark, d, "tracks"), side)


def q118_latest(spark: SparkSession, d: str) -> DataFrame:
    return conversion.latest(load(spark, d, "tracks").select("metadata_id", "updated_at"), "updated_at", "metadata_id", 100)


def q119_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed jobs with what they are about."""
    who = load(spark, d, "customer").select(c("c_custkey").alias("metadata_id"), "c_name", "c_mktsegment")
    return jobs(spark, d).where("status = 'failed'").join(who, "metadata_id").select("job_id", "stage", "c_name", "c_mktsegment")


def q120_reopened_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Done jobs of one stage whose subject lacks something are open again, those of another start afresh."""
    gaps = load(spark, d, "customer").where("c_acctbal < 0").select(c("c_custkey").alias("metadata_id"))
    return conversion.retry_stage(conversion.reopen(jobs(spark, d), "2-HIGH", gaps), "5-LOW")


def q121_expired_leases(spark: SparkSession, d: str) -> DataFrame:
    """Running jobs claimed more than a day before the newest event wait again."""
    e = load(spark, d, "events").select("event_id", "ts", "event_type")
    running = e.select("event_id", F.when(c("event_type") == "click", "running").when(c("event_type") == "error", "failed").otherwise("done").alias("status"), c("ts").alias("claimed_at"))
    return merge.expire_leases(running, F.lit(e.agg(F.max("ts")).first()[0]), 86_400).select("event_id", "status")


def q122_replace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows replaced: columns that the new rows lack become null."""
    old = load(spark, d, "technical_features").select("metadata_id", "codec", "bitrate", "duration_ms")
    new = load(spark, d, "ml_features").where("danceability > 0.5").select("metadata_id", c("tempo_category").alias("codec"))
    return merge.replace_rows(old, new, ["metadata_id"])


def q123_coalesce_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """One column takes the new value where there is one, another only where it has none."""
    old = load(spark, d, "artist_stats").select("id", "metadata_id", "country", "disambiguation")
    new = load(spark, d, "tracks").select("metadata_id", c("label").alias("country"), c("genre").alias("disambiguation"))
    out = merge.upsert(old, new.join(old.select("metadata_id", "id"), "metadata_id").drop("metadata_id"), ["id"], ["country"])
    return merge.coalesce_into(out, new, ["metadata_id"], ["disambiguation"]).select("id", "country", "disambiguation")


def q124_cloned_and_deleted(spark: SparkSession, d: str) -> DataFrame:
    """One list's members under a new id, and all lists of one kind gone from the members."""
    m = members(spark, d)
    first = load(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    gone = load(spark, d, "orders").where("o_orderpriority = '5-LOW'").select(c("o_orderkey").alias("list_id"))
    (left,) = lists.delete_lists(gone, m)
    return left.unionByName(lists.clone(m, first or 0, -1))


def q125_track_detail(spark: SparkSession, d: str) -> DataFrame:
    """Everything about every track, by part; absent parts are null, lists are empty."""
    t, lib = load(spark, d, "tracks"), library(spark, d)
    part = lambda name: load(spark, d, name).select("metadata_id", F.lit(name).alias("_"), F.struct("*").alias(name)).drop("_")
    stats = load(spark, d, "artist_stats")
    lfm, mb = _newest(spark, d, "lastfm"), _newest(spark, d, "musicbrainz")
    artist = lfm.select("metadata_id", "listeners", "play_count").join(mb.select("metadata_id", "disambiguation", "country"), "metadata_id", "full_outer")
    rows = stats.groupBy("metadata_id").agg(F.array_sort(F.collect_list(F.struct("id", "source", "listeners"))).alias("artist_stats_rows"))
    similar = stats.where("source = 'lastfm'").groupBy("metadata_id").agg(F.max_by("similar_artists", F.struct("fetched_at", "id")).alias("similar"))
    tagged = stats.where("genres is not null").groupBy("metadata_id", "source").agg(F.array_sort(F.collect_list("genres")).alias("g"))
    by_source = tagged.groupBy("metadata_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "g")))).alias("genres_by_source"), F.sum(F.size("g")).alias("genres"))
    out = t.select("metadata_id", "title").join(part("technical_features"), "metadata_id", "left").join(part("ml_features"), "metadata_id", "left")
    out = out.join(lib.select("metadata_id", "bpm", "energy", "camelot_key"), "metadata_id").join(artist, "metadata_id", "left").join(rows, "metadata_id", "left").join(by_source, "metadata_id", "left").join(similar, "metadata_id", "left")
    return out.select(
        "metadata_id", "title", c("technical_features.codec").alias("codec"), c("ml_features.genre_primary").alias("genre"), "bpm", "camelot_key", "listeners", "play_count", "disambiguation", "country",
        F.size(json_list(c("similar"))).alias("similar_artists"), F.coalesce(F.size("artist_stats_rows"), F.lit(0)).alias("stats_rows"), F.coalesce("genres", F.lit(0)).cast("long").alias("genres"),
        F.coalesce(F.array_join(F.map_keys("genres_by_source"), ","), F.lit("")).alias("genre_sources"),
    )


def q126_list_page(spark: SparkSession, d: str) -> DataFrame:
    """Lists of one kind with their sizes, the newest first."""
    o = load(spark, d, "orders").where("o_orderpriority ilike '%high%'").select(c("o_orderkey").alias("list_id"), c("o_orderpriority").alias("name"), c("o_orderdate").alias("created_at"))
    return lists.overview(o, members(spark, d).select("list_id")).orderBy(F.desc("created_at"), "list_id")


def q127_fuzzy_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Albums as lists: members that repeat an earlier title of their act, also nearly; the metric has no SQL."""
    from auricle.functions import text as txt
    from auricle.operators.resolve import fuzzy_repeats

    t = load(spark, d, "tracks").where("album != '' and title != '' and artist != ''")
    keyed = t.select(F.lower("album").alias("list_id"), "metadata_id", txt.match_key(txt.lead_artist(c("artist"))).alias("artist_key"), txt.match_key(txt.without_brackets(txt.release_title(c("title")))).alias("title_key"))
    return fuzzy_repeats(keyed, "list_id", "metadata_id")


def q128_top_genres(spark: SparkSession, d: str) -> DataFrame:
    """Per tempo class: size, tempo range, keys and the three most common genres (ties by name)."""
    r = library(spark, d).where("genre_primary is not null").join(load(spark, d, "ml_features").select("metadata_id", "tempo_category"), "metadata_id").where("tempo_category is not null")
    n = r.groupBy("tempo_category", "genre_primary").agg(F.count("*").alias("n"))
    top = n.groupBy("tempo_category").agg(F.slice(F.array_sort(F.collect_list(F.struct((-c("n")).alias("n"), "genre_primary"))), 1, 3).alias("g"))
    stats = r.groupBy("tempo_category").agg(F.count("*").alias("tracks"), F.min("bpm").alias("bpm_min"), F.max("bpm").alias("bpm_max"), F.countDistinct("camelot_key").alias("keys"))
    return stats.join(top.select("tempo_category", F.array_join(F.transform("g", lambda x: x["genre_primary"]), ",").alias("top_genres")), "tempo_category")


def q129_similar_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group ids of tracks from digests, similar titles and versions; similar ones win. The metric has no SQL."""
    from auricle.operators import dedup

    t = load(spark, d, "tracks")
    digest, ends = F.sha2("text", 256), dedup.partial_key(c("text"), 20)
    rows = dedup.remix_keys(t, F.concat_ws("|", "artist", "title", "length_seconds").alias("text"))
    told = dedup.repeated(rows, {"full": [c("text")], "part": [ends], "remix": [c("artist_key"), c("base_key")]})
    told = materialize(told.where("full or part or remix"))
    like = {name: told.where(name) for name in ("full", "part", "remix")}
    named = lambda rows, groups, by: rows.select("metadata_id", by.alias("digest")).join(groups, "digest").select("metadata_id", F.concat(F.lit("g"), "first").alias("group_id"))
    full = named(like["full"], dedup.hash_groups(like["full"], "metadata_id", digest), digest)
    part = named(like["part"], dedup.partial_groups(like["part"], "metadata_id", digest, ends), ends).join(full.select("metadata_id"), "metadata_id", "left_anti")
    stars = dedup.fuzzy_duplicates(t.join(load(spark, d, "technical_features").select("metadata_id", "duration_ms"), "metadata_id", "left"))
    fuzzy = stars.select(c("member").alias("metadata_id"), F.concat(F.lit("f"), "seed").alias("group_id")).unionByName(stars.select(c("seed").alias("metadata_id"), F.concat(F.lit("f"), "seed").alias("group_id")).distinct())
    remix = like["remix"].join(dedup.composition_groups(like["remix"]), ["artist_key", "base_key"]).select("metadata_id", F.concat(F.lit("r"), "first").alias("group_id"))
    signals = t.select("metadata_id", F.lit(None).cast("string").alias("duplicate_group"), F.lit(None).cast("string").alias("remix_group"))
    return dedup.assign_groups(signals, full, part, fuzzy, remix).where("duplicate_group is not null or remix_group is not null")


def q130_majority_probability(spark: SparkSession, d: str) -> DataFrame:
    """The most common tempo class of each genre (ties: the first by id) and its mean probability."""
    rows = load(spark, d, "ml_features").where("genre_primary is not null and tempo_category is not null")
    n = rows.groupBy("genre_primary", "tempo_category").agg(F.count("*").alias("n"), F.min("metadata_id").alias("first"), F.avg("genre_confidence").alias("p"))
    best = n.groupBy("genre_primary").agg(F.min_by(F.struct("tempo_category", "p"), F.struct((-c("n")).alias("n"), "first")).alias("b"))
    return best.select("genre_primary", c("b.tempo_category").alias("winner"), F.round("b.p", 6).alias("probability"))


def q131_numbered_members(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a list's members whose item is one of the known ones, after a check of their type."""
    known = load(spark, d, "part").where("p_size <= 25").select(c("p_partkey").cast("string").alias("item"))
    typed = members(spark, d).select("list_id", F.when(c("item_id") % 3 == 0, F.concat(F.lit("x"), c("item_id").cast("string"))).otherwise(c("item_id").cast("string")).alias("item"))
    good = typed.where(c("item").try_cast("long").isNotNull()).join(known, "item", "left_semi")
    return good.groupBy("list_id").agg(F.count("*").alias("valid"))


def q132_clamped_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten best-known tracks per genre, the wanted number clamped to 1..100."""
    wanted = F.greatest(F.lit(1), F.least(F.lit(100), F.lit(10)))
    w = Window.partitionBy("genre_primary").orderBy(F.coalesce("listeners", F.lit(0)).desc(), "metadata_id")
    rows = library(spark, d).where("genre_primary is not null").withColumn("rank", F.row_number().over(w))
    return rows.where(c("rank") <= wanted).select("genre_primary", "metadata_id", c("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (
        q97_enrich_tracks, q98_enrich_tags, q99_enrich_ids, q100_artist_updates, q101_match_ids, q102_import_tracks, q103_seeded_jobs, q104_first_of_files, q105_song_paths, q106_crawled_songs,
        q107_service_items, q108_import_members, q109_import_counts, q110_conversion_states, q111_profiles, q112_sibling_sources, q113_reconcile, q114_moves, q115_relocate, q116_writeback_audit,
        q117_inventory, q118_latest, q119_failures, q120_reopened_jobs, q121_expired_leases, q122_replace_rows, q123_coalesce_both_ways, q124_cloned_and_deleted, q125_track_detail, q126_list_page,
        q127_fuzzy_repeats, q128_top_genres, q129_similar_groups, q130_majority_probability, q131_numbered_members, q132_clamped_search,
    )
}

_SLASHED = r"replace({0}, '\', '/')"
_FILES = "(SELECT song_id AS metadata_id, title, artist, '/srv/media/' || path AS full_path FROM indexedsong)"
_FRESH = f"fresh AS (SELECT * FROM {_FILES} WHERE full_path <> '' AND lower(full_path) NOT IN (SELECT lower(full_path) FROM tracks WHERE full_path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lower(full_path) ORDER BY metadata_id) = 1)"
_STAGES = ", ".join(f"('{s}')" for s in intake.STAGES)
_PATH_KEY = r"lower(regexp_replace(regexp_replace(trim(replace(path, '\', '/')), '/+', '/', 'g'), '^/+|/+$', '', 'g'))"
_CONFIRMED = f"""{_MEMBERS}, f AS (SELECT list_id, position AS place, CAST(item_id AS VARCHAR) AS metadata_id FROM members WHERE item_id % 7 <> 0 AND item_id % 11 <> 0),
p AS (SELECT list_id, metadata_id, row_number() OVER (PARTITION BY list_id ORDER BY place, metadata_id) AS position FROM f),
k AS (SELECT * FROM p WHERE metadata_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10))"""
_MIRROR = r"'/srv/media/' || CASE WHEN regexp_matches(full_path, '^[A-Za-z]:') THEN left(full_path, 1) || '/' || regexp_replace(replace(substr(full_path, 3), '\', '/'), '^/+', '') ELSE regexp_replace(replace(full_path, '\', '/'), '^/+', '') END"

ORACLE = {
    "q97_enrich_tracks": f"""WITH {_NEWEST} SELECT t.metadata_id,
  CASE WHEN coalesce(t.album, '') <> '' THEN t.album ELSE coalesce(CASE WHEN lfm.id % 2 = 0 THEN 'L ' || lfm.country END, 'M ' || CAST(mb.id AS VARCHAR), t.album) END AS album,
  CASE WHEN coalesce(t.year, '') <> '' THEN t.year WHEN regexp_matches(substr(mb.active_years, 1, 4), '^\\d+$') THEN substr(mb.active_years, 1, 4) ELSE t.year END AS year,
  CASE WHEN coalesce(t.length_seconds, '') <> '' THEN t.length_seconds WHEN lfm.listeners > 0 THEN CAST(lfm.listeners AS VARCHAR) ELSE t.length_seconds END AS length_seconds
FROM tracks t LEFT JOIN lfm USING (metadata_id) LEFT JOIN mb USING (metadata_id)""",
    "q98_enrich_tags": f"""WITH {_NEWEST}, old AS (SELECT metadata_id, CASE WHEN danceability > 0.5 THEN 'lastfm' ELSE 'musicbrainz' END AS source, genre_primary AS tag, genre_confidence AS confidence FROM ml_features WHERE genre_primary IS NOT NULL),
f AS (SELECT metadata_id, 'lastfm' AS source, country AS tag, CASE WHEN id % 3 > 0 THEN id % 3 * 10 / 100 END AS confidence FROM lfm WHERE country <> ''),
s AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.metadata_id = old.metadata_id AND f.source = old.source AND f.tag = old.tag) UNION ALL SELECT * FROM f),
m AS (SELECT DISTINCT metadata_id, 'lastfm_artist' AS source, disambiguation AS tag FROM lfm WHERE disambiguation <> '' UNION ALL SELECT DISTINCT metadata_id, 'musicbrainz', country FROM mb WHERE country <> ''
  UNION ALL SELECT DISTINCT metadata_id, 'musicbrainz_artist', disambiguation FROM mb WHERE disambiguation <> '')
SELECT * FROM s UNION ALL SELECT metadata_id, source, tag, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.metadata_id = m.metadata_id AND s.source = m.source AND s.tag = m.tag)""",
    "q99_enrich_ids": f"""WITH {_NEWEST}, old AS (SELECT metadata_id, 'musicbrainz_artist' AS source, 'act-' || metadata_id AS external_id, CAST(0.5 AS DOUBLE) AS confidence FROM ml_features),
a AS (SELECT * FROM mb WHERE metadata_id NOT IN (SELECT metadata_id FROM technical_features WHERE channels = 1)),
n AS (SELECT metadata_id, 'musicbrainz' AS source, 'rec-' || CAST(id AS VARCHAR) AS external_id FROM a UNION SELECT metadata_id, 'musicbrainz_artist', 'act-' || metadata_id FROM a WHERE id % 2 = 0
  UNION SELECT metadata_id, 'musicbrainz_artist', 'act-' || metadata_id FROM mb UNION SELECT metadata_id, 'isrc', 'ISRC' || CAST(id AS VARCHAR) FROM a)
SELECT * FROM old UNION ALL SELECT metadata_id, source, external_id, 1.0::DOUBLE FROM n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.metadata_id = n.metadata_id AND old.source = n.source AND old.external_id = n.external_id)""",
    "q100_artist_updates": f"WITH {_NEWEST} SELECT s.id, s.source, CASE WHEN s.source = 'musicbrainz' THEN coalesce(upper(mb.country), s.country) ELSE s.country END AS country, s.active_years FROM artist_stats s LEFT JOIN mb USING (metadata_id)",
    "q101_match_ids": """WITH m AS (SELECT * FROM ml_features WHERE genre_primary IS NOT NULL), h AS (SELECT metadata_id, genre_confidence AS score, genre_primary AS r FROM m UNION ALL SELECT metadata_id, genre_confidence * 0.8::DOUBLE, genre_secondary FROM m WHERE genre_secondary IS NOT NULL),
p AS (SELECT metadata_id, repeat('print' || metadata_id, 3) AS f FROM technical_features WHERE sample_rate % 4 <> 1), old AS (SELECT metadata_id, 'musicbrainz' AS source, genre_primary AS external_id, 1.0::DOUBLE AS confidence FROM m WHERE genre_confidence > 0.9),
g AS (SELECT * FROM h JOIN p USING (metadata_id) WHERE score >= 0.5), n AS (SELECT metadata_id, 'musicbrainz' AS source, r AS external_id, max(score) AS confidence FROM g WHERE r <> '' GROUP BY 1, 2, 3 UNION ALL SELECT metadata_id, 'acoustid', substr(f, 1, 64), max(score) FROM g GROUP BY 1, 2, 3)
SELECT metadata_id, source, external_id, round(confidence, 6) AS confidence FROM (SELECT * FROM old UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.metadata_id = n.metadata_id AND old.source = n.source AND old.external_id = n.external_id))""",
    "q102_import_tracks": f"WITH {_FRESH} SELECT * FROM fresh",
    "q103_seeded_jobs": f"WITH {_FRESH} SELECT metadata_id, s.stage, CASE WHEN s.stage = 'import' THEN 'done' ELSE 'pending' END AS status, 0 AS attempts FROM fresh, (VALUES {_STAGES}) s(stage)",
    "q104_first_of_files": """SELECT metadata_id, file_path AS path, year AS filename FROM tracks WHERE coalesce(file_path || year, '') <> '' QUALIFY row_number() OVER (PARTITION BY file_path, year ORDER BY metadata_id) = 1
UNION ALL SELECT metadata_id, file_path, year FROM tracks WHERE coalesce(file_path || year, '') = ''""",
    "q105_song_paths": f"""WITH w AS (SELECT {_PATH_KEY} AS path_key, song_id FROM indexedsong WHERE path IS NOT NULL AND {_PATH_KEY} <> ''), f AS (SELECT path_key, max(song_id) AS song_id FROM w GROUP BY 1)
SELECT * FROM f UNION ALL SELECT path_key, min(song_id) FROM (SELECT regexp_replace(path_key, '^[^/]*/', '') AS path_key, song_id FROM w WHERE instr(path_key, '/') > 0) WHERE path_key <> '' AND path_key NOT IN (SELECT path_key FROM f) GROUP BY 1""",
    "q106_crawled_songs": "SELECT song_id, coalesce(title, '') AS title, coalesce(artist, '') AS artist, coalesce(album, '') AS album, coalesce(path, '') AS path FROM indexedsong",
    "q107_service_items": f"""WITH {_MEMBERS} SELECT list_id, CAST(item_id AS VARCHAR) AS track_id, 'T' || CAST(item_id AS VARCHAR) AS title, 'A' || CAST(item_id AS VARCHAR) || ', Z' || CAST(item_id AS VARCHAR) AS artist, 'B' || CAST(item_id AS VARCHAR) AS album,
  item_id * 1000 AS duration_ms, row_number() OVER (PARTITION BY list_id ORDER BY position) AS position FROM members WHERE item_id % 5 <> 0""",
    "q108_import_members": f"WITH {_CONFIRMED} SELECT list_id, metadata_id, min(position) AS position FROM k GROUP BY 1, 2",
    "q109_import_counts": f"WITH {_CONFIRMED} SELECT list_id, count(*) AS track_count FROM k GROUP BY 1",
    "q110_conversion_states": """WITH e AS (SELECT metadata_id, channels = 1 AND bitrate IS NOT NULL AS done, CASE WHEN bitrate IS NULL THEN 'missing_source' WHEN integrity_ok IS NULL OR integrity_ok NOT IN (1) THEN 'encoder_failed'
  WHEN sample_rate IS NULL OR sample_rate = 48000 OR duration_ms IS NULL THEN 'missing_output' WHEN duration_ms = 0 THEN 'empty_output' WHEN NOT coalesce(clipping_ratio < 0.01, true) THEN 'finalize_failed' END AS error FROM technical_features)
SELECT metadata_id, CASE WHEN done THEN 'skipped_existing' WHEN error IS NOT NULL THEN 'failed' ELSE 'converted' END AS status, CASE WHEN NOT coalesce(done, false) THEN error END AS error FROM e""",
    "q111_profiles": "SELECT metadata_id, coalesce(lower(nullif(trim(codec), '')), 'unknown') AS codec, CAST(coalesce(bitrate // 1000, 0) AS INTEGER) AS kbps FROM technical_features",
    "q112_sibling_sources": rf"""WITH t AS (SELECT {_SLASHED.format('lower(full_path)')} AS path FROM tracks WHERE full_path IS NOT NULL), f AS (SELECT DISTINCT path FROM (SELECT path FROM t UNION ALL SELECT regexp_replace(path, '\.[a-z0-9]+$', '.opus') FROM t)),
k AS (SELECT path, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS kind, regexp_replace(path, '\.[A-Za-z0-9]+$', '') AS stem FROM f),
b AS (SELECT stem, path AS source FROM k WHERE kind <> '' AND kind <> 'opus' QUALIFY row_number() OVER (PARTITION BY stem ORDER BY coalesce(list_position({conversion.ORIGINALS}, kind), 100), path) = 1)
SELECT path, source FROM k JOIN b USING (stem) WHERE kind = 'opus'""",
    "q113_reconcile": rf"""WITH t AS (SELECT metadata_id, full_path, year, {_SLASHED.format('full_path')} AS p FROM tracks), m AS (SELECT DISTINCT regexp_replace(p, '\.[A-Za-z0-9]+$', '.opus') AS target FROM t WHERE year LIKE '%5'),
s AS (SELECT t.*, CASE WHEN ends_with(lower(p), '.opus') THEN 'already' WHEN regexp_replace(p, '\.[A-Za-z0-9]+$', '.opus') IN (SELECT target FROM m WHERE target IS NOT NULL) THEN 'updated' ELSE 'missing' END AS status FROM t)
SELECT metadata_id, status, CASE WHEN status = 'updated' THEN regexp_replace(p, '\.[A-Za-z0-9]+$', '.opus') ELSE full_path END AS full_path FROM s""",
    "q114_moves": rf"""WITH m AS (SELECT metadata_id, full_path AS source, {_MIRROR} AS target FROM tracks WHERE full_path <> '')
SELECT *, CASE WHEN starts_with({_SLASHED.format('source')}, '/srv/media/') THEN 'in_place' WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'conflict' ELSE 'move' END AS status FROM m""",
    "q115_relocate": r"""WITH t AS (SELECT metadata_id, file_path, filename, full_path, CASE WHEN starts_with(full_path, 'D:') THEN replace(full_path, 'D:', 'E:') END AS n FROM tracks)
SELECT metadata_id, CASE WHEN n IS NULL THEN file_path ELSE regexp_replace(n, '[^\\/]*$', '') END AS file_path, CASE WHEN n IS NULL THEN filename ELSE regexp_extract(n, '([^\\/]*)$', 1) END AS filename, coalesce(n, full_path) AS full_path FROM t""",
    "q116_writeback_audit": f"""WITH {LIB}, n AS (SELECT metadata_id, CAST(CAST(round_even(bpm, 0) AS INTEGER) AS VARCHAR) AS b, camelot_key AS k, genre_primary AS g, genre AS old_g FROM lib),
u AS (SELECT metadata_id, 'bpm_tag' AS field, CAST(NULL AS VARCHAR) AS old_value, b AS new_value FROM n UNION ALL SELECT metadata_id, 'key_tag', '1A', k FROM n UNION ALL SELECT metadata_id, 'genre_tag', old_g, g FROM n)
SELECT * FROM u WHERE new_value IS NOT NULL AND new_value IS DISTINCT FROM old_value""",
    "q117_inventory": "SELECT t.metadata_id, t.full_path, CASE WHEN x.metadata_id IS NOT NULL THEN x.metadata_id || '.json' END AS sidecar_path FROM tracks t LEFT JOIN (SELECT metadata_id FROM technical_features WHERE integrity_ok = 1) x USING (metadata_id)",
    "q118_latest": "SELECT metadata_id, updated_at FROM tracks ORDER BY updated_at DESC NULLS LAST, metadata_id LIMIT 100",
    "q119_failures": f"WITH {_JOBS} SELECT job_id, stage, c_name, c_mktsegment FROM jobs JOIN customer ON c_custkey = metadata_id WHERE status = 'failed'",
    "q120_reopened_jobs": f"""WITH {_JOBS} SELECT job_id, stage, CASE WHEN stage = '5-LOW' AND status <> 'running' THEN 'pending' WHEN stage = '2-HIGH' AND status = 'done' AND metadata_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'pending' ELSE status END AS status,
  CASE WHEN stage = '5-LOW' AND status <> 'running' THEN 0 ELSE attempts END AS attempts, metadata_id FROM jobs""",
    "q121_expired_leases": "SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS THEN 'pending' ELSE 'running' END WHEN 'error' THEN 'failed' ELSE 'done' END AS status FROM events",
    "q122_replace_rows": """WITH n AS (SELECT metadata_id, tempo_category AS codec FROM ml_features WHERE danceability > 0.5)
SELECT metadata_id, codec, bitrate, duration_ms FROM technical_features WHERE metadata_id NOT IN (SELECT metadata_id FROM n) UNION ALL SELECT metadata_id, codec, NULL, NULL FROM n""",
    "q123_coalesce_both_ways": "SELECT s.id, coalesce(t.label, s.country) AS country, coalesce(s.disambiguation, t.genre) AS disambiguation FROM artist_stats s LEFT JOIN tracks t USING (metadata_id)",
    "q124_cloned_and_deleted": f"""WITH {_MEMBERS} SELECT list_id, item_id, position FROM members WHERE list_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION ALL SELECT -1, item_id, position FROM members WHERE list_id = (SELECT min(o_orderkey) FROM orders)""",
    "q125_track_detail": f"""WITH {LIB}, {_NEWEST}, r AS (SELECT metadata_id, count(*) AS n, count(genres) AS g, string_agg(DISTINCT CASE WHEN genres IS NOT NULL THEN source END, ',' ORDER BY CASE WHEN genres IS NOT NULL THEN source END) AS gs FROM artist_stats GROUP BY 1)
SELECT t.metadata_id, t.title, x.codec, m.genre_primary AS genre, lib.bpm, lib.camelot_key, lfm.listeners, lfm.play_count, mb.disambiguation, mb.country,
  CASE WHEN json_valid(lfm.similar_artists) AND json_type(lfm.similar_artists) = 'ARRAY' THEN CAST(json_array_length(lfm.similar_artists) AS INTEGER) ELSE 0 END AS similar_artists,
  CAST(coalesce(r.n, 0) AS INTEGER) AS stats_rows, coalesce(r.g, 0) AS genres, coalesce(r.gs, '') AS genre_sources
FROM tracks t LEFT JOIN technical_features x USING (metadata_id) LEFT JOIN ml_features m USING (metadata_id) JOIN lib USING (metadata_id) LEFT JOIN lfm USING (metadata_id) LEFT JOIN mb USING (metadata_id) LEFT JOIN r USING (metadata_id)""",
    "q126_list_page": f"WITH {_MEMBERS} SELECT o_orderkey AS list_id, o_orderpriority AS name, o_orderdate AS created_at, count(list_id) AS members FROM orders LEFT JOIN members ON list_id = o_orderkey WHERE o_orderpriority ILIKE '%high%' GROUP BY 1, 2, 3",
    "q128_top_genres": f"""WITH {LIB}, r AS (SELECT lib.*, m.tempo_category FROM lib JOIN ml_features m USING (metadata_id) WHERE lib.genre_primary IS NOT NULL AND m.tempo_category IS NOT NULL),
n AS (SELECT tempo_category, genre_primary, row_number() OVER (PARTITION BY tempo_category ORDER BY count(*) DESC, genre_primary) AS i FROM r GROUP BY 1, 2)
SELECT r.tempo_category, count(*) AS tracks, min(bpm) AS bpm_min, max(bpm) AS bpm_max, count(DISTINCT camelot_key) AS keys, (SELECT string_agg(genre_primary, ',' ORDER BY i) FROM n WHERE n.tempo_category = r.tempo_category AND i <= 3) AS top_genres FROM r GROUP BY 1""",
    "q130_majority_probability": """WITH n AS (SELECT genre_primary, tempo_category, count(*) AS n, min(metadata_id) AS first, avg(genre_confidence) AS p FROM ml_features WHERE genre_primary IS NOT NULL AND tempo_category IS NOT NULL GROUP BY 1, 2)
SELECT genre_primary, tempo_category AS winner, round(p, 6) AS probability FROM n QUALIFY row_number() OVER (PARTITION BY genre_primary ORDER BY n DESC, first) = 1""",
    "q131_numbered_members": f"WITH {_MEMBERS} SELECT list_id, count(*) AS valid FROM members WHERE item_id % 3 <> 0 AND item_id IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY 1",
    "q132_clamped_search": f"WITH {LIB} SELECT genre_primary, metadata_id, row_number() OVER (PARTITION BY genre_primary ORDER BY coalesce(listeners, 0) DESC, metadata_id) AS rank FROM lib WHERE genre_primary IS NOT NULL QUALIFY rank <= 10",
}
