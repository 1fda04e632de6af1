"""What catalogues know about tracks, merged with a fixed precedence; ids from fingerprint lookups.

Inputs are parsed payloads, one row per track: ``lastfm`` (metadata_id, listeners, play_count, duration_ms, album,
tags of (name, count)), ``lastfm_artist`` (metadata_id, tags), ``recording`` (metadata_id, recording_id, artist_id,
isrcs, tags, date, album), ``artist`` (metadata_id, artist_id, tags, active_years, country). A track without an answer
has no row; null and empty values change nothing; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.coerce import blank
from auricle.operators import merge
from auricle.operators.pipeline import tag_confidence

#: Score from which a fingerprint's recording counts.
LEAST = 0.5


def year_of(date: Column) -> Column:
    """The leading year of a release date, where its first four characters are digits."""
    four = F.substr(date, F.lit(1), F.lit(4))
    return F.when(four.rlike(r"^\d+$"), four)


def without_embedded(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tracks whose files hold no recording id yet, as only these are asked for."""
    return tracks.join(ids.where("source = 'musicbrainz'").select("metadata_id").distinct(), "metadata_id", "left_anti")


def fill_tracks(tracks: DataFrame, lastfm: DataFrame, recording: DataFrame) -> DataFrame:
    """Length, album and year where they are empty; for albums last.fm comes before recordings."""
    seconds = F.when(F.col("duration_ms") > 0, F.expr("duration_ms div 1000").cast("string"))
    lfm = lastfm.select("metadata_id", seconds.alias("_length"), F.nullif(F.col("album"), F.lit("")).alias("_lfm_album"))
    rec = recording.select("metadata_id", year_of(F.col("date")).alias("_year"), F.nullif(F.col("album"), F.lit("")).alias("_rec_album"))
    joined = tracks.join(lfm, "metadata_id", "left").join(rec, "metadata_id", "left")
    new = {"length_seconds": F.col("_length"), "album": F.coalesce("_lfm_album", "_rec_album"), "year": F.col("_year")}
    fill = lambda c: F.when(blank(F.col(c)), F.coalesce(new[c], F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[fill(c) if c in new else F.col(c) for c in tracks.columns])


def merge_tags(old: DataFrame, lastfm: DataFrame, lastfm_artist: DataFrame, recording: DataFrame, artist: DataFrame) -> DataFrame:
    """(metadata_id, source, tag, confidence): last.fm's counts replace confidences, tags of the others are added where they are new."""
    key = ["metadata_id", "source", "tag"]
    counted = lastfm.select("metadata_id", F.explode("tags").alias("t")).select("metadata_id", F.lit("lastfm").alias("source"), F.col("t.name").alias("tag"), tag_confidence(F.col("t.count")).alias("confidence"))
    # of one tag that a payload repeats the last one counts; the greatest stands for it, as rows have no order
    fresh = counted.where("tag != ''").groupBy(*key).agg(F.max("confidence").alias("confidence"))
    state = merge.replace_rows(old.select(*key, "confidence"), fresh, key)
    plain = [(lastfm_artist, "lastfm_artist"), (recording, "musicbrainz"), (artist, "musicbrainz_artist")]
    named = [df.select("metadata_id", F.lit(name).alias("source"), F.explode("tags").alias("tag"), F.lit(None).cast("double").alias("confidence")) for df, name in plain]
    more = named[0].unionByName(named[1]).unionByName(named[2]).where("tag != ''").distinct()
    return state.unionByName(more.join(state.select(*key), key, "left_anti"))


def merge_ids(old: DataFrame, recording: DataFrame, artist: DataFrame) -> DataFrame:
    """(metadata_id, source, external_id, confidence): new ids of recordings, acts and codes at confidence 1; known ones stay."""
    pair = lambda df, source, value: df.select("metadata_id", F.lit(source).alias("source"), value.alias("external_id"))
    new = (
        pair(recording, "musicbrainz", F.col("recording_id"))
        .unionByName(pair(recording, "musicbrainz_artist", F.col("artist_id")))
        .unionByName(pair(artist, "musicbrainz_artist", F.col("artist_id")))
        .unionByName(pair(recording, "isrc", F.explode("isrcs")))
    )
    key = ["metadata_id", "source", "external_id"]
    fresh = new.where("external_id != ''").distinct().join(old.select(*key), key, "left_anti").withColumn("confidence", F.lit(1.0))
    return old.select(*key, "confidence").unionByName(fresh)


def merge_artist_stats(old: DataFrame, artist: DataFrame) -> DataFrame:
    """Active years and country of catalogue rows, where the answer has them; a row's own value stays where it has not."""
    new = artist.select("metadata_id", F.col("active_years").alias("_years"), F.col("country").alias("_country"))
    hit = F.col("source") == "musicbrainz"
    joined = old.join(new, "metadata_id", "left")
    return joined.withColumn("active_years", F.when(hit, F.coalesce("_years", "active_years")).otherwise(F.col("active_years"))).withColumn(
        "country", F.when(hit, F.coalesce("_country", "country")).otherwise(F.col("country"))
    ).select(*old.columns)


def match_ids(hits: DataFrame, fingerprints: DataFrame, old: DataFrame) -> DataFrame:
    """Ids with those of fingerprint hits from ``LEAST`` on: each recording with its score, and once the fingerprint's first 64 letters with the highest.

    ``hits`` is (metadata_id, score, recording_id), ``fingerprints`` (metadata_id, fingerprint); tracks without one match nothing.
    """
    known = fingerprints.where("fingerprint != ''")
    good = hits.where(F.col("score") >= LEAST).join(known, "metadata_id")
    best = lambda source, value: good.select("metadata_id", F.lit(source).alias("source"), value.alias("external_id"), "score")
    new = best("musicbrainz", F.col("recording_id")).unionByName(best("acoustid", F.substr("fingerprint", F.lit(1), F.lit(64)))).where("external_id != ''")
    key = ["metadata_id", "source", "external_id"]
    fresh = new.groupBy(*key).agg(F.max("score").alias("confidence")).join(old.select(*key), key, "left_anti")
    return old.select(*key, "confidence").unionByName(fresh)
