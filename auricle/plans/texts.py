"""Keys, parsed names, payloads and labels over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.functions import audio, coerce, features, paths
from auricle.functions import text as txt
from auricle.functions.similarity import fuzzy_match_score, ratio_udf
from auricle.io import load
from auricle.operators.pipeline import tag_confidence
from auricle.plans.library import LIB, library
from auricle.plans.signals import ORACLE as SIGNALS
from auricle.sources import records

c = F.col


def q79_fill_from_filename(spark: SparkSession, d: str) -> DataFrame:
    """Title and artist, from the file's name where they are blank."""
    t = load(spark, d, "tracks")
    fill = lambda name: txt.fill_from_filename(c(name), c("filename"), name).alias(name)
    return t.select("metadata_id", fill("title"), fill("artist"))


def q80_match_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tracks").select("metadata_id", txt.match_key(c("title")).alias("title_key"), txt.match_key(c("artist")).alias("artist_key"))


def q81_release_titles(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "indexedsong")
    return t.select("song_id", txt.release_title(c("title")).alias("release"), txt.without_brackets(c("title")).alias("bare"), txt.lead_artist(c("artist")).alias("lead"))


def q82_ascii_keys(spark: SparkSession, d: str) -> DataFrame:
    """Decomposed keys and the artist's variants; SQL has no decomposition."""
    t = load(spark, d, "tracks")
    return t.select("metadata_id", txt.title_key(c("title")).alias("title_key"), F.array_join(txt.artist_keys(c("artist")), "|").alias("artist_keys"), txt.import_key(c("title")).alias("import_key"))


def q83_playlist_ids(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, URIs, bare ids and other texts made from order keys."""
    o = load(spark, d, "orders").select("o_orderkey", F.lpad(c("o_orderkey").cast("string"), 22, "A").alias("i"))
    form = (
        F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("https://open.example/playlist/"), "i", F.lit("?si=1")))
        .when(c("o_orderkey") % 4 == 1, F.concat(F.lit("service:playlist:"), "i"))
        .when(c("o_orderkey") % 4 == 2, c("i"))
        .otherwise(F.concat("i", F.lit("-x")))
    )
    return o.select("o_orderkey", txt.playlist_id(form).alias("playlist_id"))


def q84_fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted score of songs and tracks of one album, title and artist by similarity; the metric has no SQL."""
    t = load(spark, d, "tracks").select("metadata_id", F.lower("title").alias("ta"), F.lower("artist").alias("aa"), F.lower("album").alias("album")).where("ta != '' and aa != '' and album != ''")
    s = load(spark, d, "indexedsong").select("song_id", F.lower("title").alias("tb"), F.lower("artist").alias("ab"), F.lower("album").alias("album")).where("tb != '' and ab != ''")
    ms = load(spark, d, "technical_features").select("metadata_id", F.abs(c("duration_ms") % 40_000).alias("gap"))
    met = t.join(s, ["album"]).where(F.substr("ta", F.lit(1), F.lit(3)) == F.substr("tb", F.lit(1), F.lit(3))).join(ms, "metadata_id", "left")
    return met.select("metadata_id", "song_id", F.round(fuzzy_match_score(ratio_udf("aa", "ab"), ratio_udf("ta", "tb"), c("gap")), 6).alias("score"))


def q85_key_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """The key of each track against one made from its duration."""
    other = F.concat((F.expr("duration_ms div 12") % 12 + 1).cast("string"), F.when(F.expr("duration_ms div 24") % 2 == 0, "A").otherwise("B"))
    rows = library(spark, d).select("metadata_id", "camelot_key", F.when(c("duration_ms").isNotNull(), other).alias("other"))
    return rows.select("metadata_id", features.camelot_compatible(c("camelot_key"), c("other")).cast("int").alias("fits"))


def q86_integrity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of messages of a decoder, made from the codec and the written errors."""
    said = F.concat_ws("; ", F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (c("sample_rate") % len(MESSAGES) + 1).cast("int")), "integrity_errors")
    t = load(spark, d, "technical_features")
    return t.select("metadata_id", F.array_join(features.integrity_labels(F.when(c("integrity_ok") == 0, said)), ",").alias("labels"))


MESSAGES = ["Header missing", "Skipped 12 bytes", "CRC mismatch at 7", "something else", "invalid frame size", "file TRUNCATED", "Giving up resync"]


def q87_json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Issues as lists; texts that are no list are empty ones."""
    m = load(spark, d, "ml_features")
    return m.select("metadata_id", F.size(coerce.json_list(c("quality_issues"))).alias("issues"), F.array_join(coerce.json_list(c("quality_issues")), ",").alias("joined"))


def q88_tag_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "artist_stats")
    return s.select("id", F.round(tag_confidence(c("listeners") % 101), 6).alias("confidence"), coerce.leading_int(c("active_years")).alias("since"), coerce.truthy(c("play_count"), 1).cast("long").alias("plays"))


def q89_probe_reports(spark: SparkSession, d: str) -> DataFrame:
    """Technical rows written as a probe's report and read back: the first audio stream, the container's bit rate first."""
    t = load(spark, d, "technical_features")
    text = lambda name: c(name).cast("string")
    audio_stream = F.struct(F.lit("audio").alias("codec_type"), c("codec").alias("codec_name"), F.when(c("channels") == 2, text("bitrate")).alias("bit_rate"), text("sample_rate").alias("sample_rate"), c("channels").cast("int").alias("channels"))
    cover = F.struct(F.lit("video").alias("codec_type"), F.lit("png").alias("codec_name"), F.lit(None).cast("string").alias("bit_rate"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("int").alias("channels"))
    tags = F.create_map(F.lit("TITLE"), c("metadata_id"), F.lit("Artist"), c("codec"))
    form = F.struct(F.when(c("channels") != 2, text("bitrate")).alias("bit_rate"), (c("duration_ms") / 1000).cast("string").alias("duration"), tags.alias("tags"))
    report = F.to_json(F.struct(F.array(cover, audio_stream).alias("streams"), form.alias("format")))
    p = t.select("metadata_id", records.probe_report(report).alias("p"))
    return p.select("metadata_id", "p.codec", "p.bitrate", "p.sample_rate", "p.channels", c("p.tags")["title"].alias("tag_title"))


def q90_lastfm_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and albums written as a service's track payload and read back."""
    s = load(spark, d, "artist_stats").where("source = 'lastfm'").join(load(spark, d, "tracks").select("metadata_id", "album"), "metadata_id")
    tag = F.struct(c("country").alias("name"), (c("id") % 100).cast("int").alias("count"))
    body = F.struct(c("listeners").cast("string").alias("listeners"), c("play_count").cast("string").alias("playcount"), F.struct(c("album").alias("title")).alias("album"), F.struct(F.array(tag).alias("tag")).alias("toptags"))
    p = s.select("id", records.lastfm_track(F.to_json(F.struct(body.alias("track")))).alias("p"))
    return p.select("id", "p.listeners", "p.play_count", "p.album", F.size("p.tags").alias("tags"), c("p.tags")[0]["count"].alias("first_count"))


def q91_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Tracks and their act's statistics written as search results and read back: the first hit of each."""
    t = load(spark, d, "tracks").select("metadata_id", "title", "album", "year")
    release = F.struct(c("album").alias("title"), c("year").alias("date"))
    hit = F.struct(c("metadata_id").alias("id"), c("title").alias("title"), F.array(F.concat(F.lit("ISRC"), F.right("metadata_id", F.lit(4)))).alias("isrcs"), F.array(release).alias("releases"))
    r = t.select("metadata_id", records.recording(F.to_json(F.struct(F.array(hit, hit).alias("recordings")))).alias("r"))
    s = load(spark, d, "artist_stats").where("source = 'musicbrainz'").groupBy("metadata_id").agg(F.max_by(F.struct("country", "disambiguation", "active_years"), "id").alias("s"))
    span = F.struct(F.substr("s.active_years", F.lit(1), F.lit(4)).alias("begin"), F.lit(None).cast("string").alias("end"))
    act = F.struct(c("metadata_id").alias("id"), c("s.country").alias("country"), c("s.disambiguation").alias("disambiguation"), span.alias("life-span"))
    a = s.select("metadata_id", records.artist(F.to_json(F.struct(F.array(act).alias("artists")))).alias("a"))
    return r.join(a, "metadata_id", "left").select("metadata_id", "r.title", "r.isrc", "r.album", "r.date", "a.country", "a.active_years")


def q92_fingerprint_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each track as a lookup of two results, itself and a worse one: every hit, and the best one."""
    t = load(spark, d, "tracks").where("title != '' and artist != ''")
    recording = lambda i, title: F.struct(i.alias("id"), title.alias("title"), F.array(F.struct(c("artist").alias("name"))).alias("artists"), F.array(F.struct(c("album").alias("title"))).alias("releases"))
    result = lambda score, r: F.struct(F.lit("r").alias("id"), F.lit(score).alias("score"), F.array(r).alias("recordings"))
    other = recording(F.concat(F.lit("x-"), "metadata_id"), F.concat("title", F.lit(" (Live)")))
    body = F.to_json(F.struct(F.array(result(0.4, other), result(0.9, recording(c("metadata_id"), c("title")))).alias("results")))
    hits = records.fingerprint_hits(t.select(c("metadata_id").alias("k"), body.alias("body")), "k", "body")
    best = records.best_hit(hits, "k")
    return hits.join(best.select("k", c("recording_id").alias("best")), "k").select("k", "score", "recording_id", "title", "artist", "album", "best")


def q93_moved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Sidecars, mirrored targets and shortened paths of every file."""
    t = load(spark, d, "tracks")
    p = c("full_path")
    return t.select("metadata_id", paths.sidecar(p).alias("sidecar"), paths.mirrored(p, "/quarantine").alias("mirrored"), paths.long_form(p).alias("long_form"), paths.safe_target(p, "opus").alias("target"))


def q94_durations(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "technical_features")
    return t.select("metadata_id", coerce.minutes_seconds(c("duration_ms")).alias("shown"), coerce.utc_stamp(c("analyzed_at")).alias("stamp"), coerce.python_json(F.array("codec", F.lit("x"))).alias("listed"), coerce.stable_id("metadata_id", "codec").alias("stable_id"))


def q95_feature_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Features with the defaults of a classifier where they are absent or 0."""
    r = library(spark, d).select("metadata_id", "bpm", "energy")
    out = features.with_defaults(r.withColumn("dynamic_range", F.lit(0.0)).withColumn("onsets", F.lit(None).cast("double")))
    return out.select("metadata_id", "bpm", F.round("energy", 6).alias("energy"), "dynamic_range", "onsets", "rms", "key", "mode")


def q96_signal_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic range in dB, onsets a second and the cutoff below which nearly all energy lies."""
    e = load(spark, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.round(audio.dynamic_range(c("v")), 4).alias("db"), F.round(audio.onset_rate(F.size(F.filter("v", lambda x: x > 0)), F.lit(4.0)), 6).alias("onsets"), audio.cutoff_bin(c("v")).cast("long").alias("cutoff"))


def q141_camelot_signals(spark: SparkSession, d: str) -> DataFrame:
    """The wheel key of a note and a mode made from the duration; unknown ones have none."""
    ms = c("duration_ms")
    note = audio.note_at(ms % 12)
    mode = F.when(ms % 7 == 0, "unknown").when(ms % 2 == 0, "major").otherwise("minor")
    return library(spark, d).select("metadata_id", features.camelot(note, mode).alias("camelot_key"))


def q142_list_durations(spark: SparkSession, d: str) -> DataFrame:
    """Whole duration of every album, in milliseconds and as it is shown; unknown ones count as 0."""
    rows = library(spark, d).where("album != ''").groupBy("album").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).cast("long").alias("ms"))
    return rows.select("album", "ms", coerce.minutes_seconds(c("ms")).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        q79_fill_from_filename, q80_match_keys, q81_release_titles, q82_ascii_keys, q83_playlist_ids, q84_fuzzy_scores, q85_key_compatibility, q86_integrity_labels,
        q87_json_lists, q88_tag_confidence, q89_probe_reports, q90_lastfm_tracks, q91_recordings, q92_fingerprint_hits, q93_moved_paths, q94_durations, q95_feature_defaults, q96_signal_ranges,
        q141_camelot_signals, q142_list_durations,
    )
}

_SPACE = r"[\s\x0b\x85\p{Z}]"
_strip = lambda x: rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_WORDS = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\s\x0b\x85\p{Z}]"
_match_key = lambda x: _strip(rf"regexp_replace(regexp_replace(lower({x}), '{_WORDS}', '', 'g'), '{_SPACE}+', ' ', 'g')")
_q = lambda p: p.replace("'", "''")


def _release(x: str) -> str:
    out = _strip(f"coalesce({x}, '')")
    for _ in range(3):
        for pattern in (txt._DASH, txt._BRACKET, txt._GUEST):
            out = f"regexp_replace({out}, '{_q(pattern)}', '', 'g')"
        out = _strip(f"regexp_replace({_strip(out)}, '[-–—]+$', '')")
    return out


def _lead(x: str) -> str:
    out = _strip(f"coalesce({x}, '')")
    for separator in (",", ";", " & ", " x ", " X "):
        out = f"(SELECT CASE WHEN instr(v, '{separator}') > 0 THEN {_strip(f"string_split(v, '{separator}')[1]")} ELSE v END FROM (SELECT {out} AS v))"
    return out


_SAFE = r"CASE WHEN regexp_matches(lower({0}), '\.[a-z0-9]+$') THEN regexp_replace({0}, '\.[A-Za-z0-9]+$', '') ELSE {0} END"
_LABELS = ", ".join(f"CASE WHEN regexp_matches(s, '(?i){p}') THEN '{label}' END" for p, label in features.CORRUPTION)

_KEY = "CASE " + " ".join(f"WHEN note = '{k}' AND mode = '{m}' THEN '{v}'" for (k, m), v in features.CAMELOT.items()) + " END"

ORACLE = {
    "q141_camelot_signals": f"""WITH {LIB}, n AS (SELECT metadata_id, ({audio.NOTES})[CAST(duration_ms % 12 + 1 AS INTEGER)] AS note, CASE WHEN duration_ms % 7 = 0 THEN 'unknown' WHEN duration_ms % 2 = 0 THEN 'major' ELSE 'minor' END AS mode FROM lib)
SELECT metadata_id, {_KEY} AS camelot_key FROM n""",
    "q142_list_durations": f"""WITH {LIB}, a AS (SELECT album, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS ms FROM lib WHERE album <> '' GROUP BY 1)
SELECT album, ms, CAST(ms // 60000 AS VARCHAR) || 'm ' || CAST((ms // 1000) % 60 AS VARCHAR) || 's' AS shown FROM a""",
    "q79_fill_from_filename": f"""WITH p AS ({SIGNALS["q46_filename_parse"]}) SELECT t.metadata_id, CASE WHEN trim(coalesce(t.title, '')) = '' AND p.title <> '' THEN p.title ELSE t.title END AS title,
  CASE WHEN trim(coalesce(t.artist, '')) = '' AND p.artist <> '' THEN p.artist ELSE t.artist END AS artist FROM tracks t LEFT JOIN p USING (metadata_id)""",
    "q80_match_keys": f"SELECT metadata_id, {_match_key('title')} AS title_key, {_match_key('artist')} AS artist_key FROM tracks",
    "q81_release_titles": rf"""SELECT song_id, {_release('title')} AS release, {_strip(r"regexp_replace(regexp_replace(coalesce(title, ''), '\s*\([^)]*\)', '', 'g'), '\s*\[[^\]]*\]', '', 'g')")} AS bare, {_lead('artist')} AS lead FROM indexedsong""",
    "q83_playlist_ids": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 22, 'A') END AS playlist_id FROM orders",
    "q85_key_compatibility": f"""WITH {LIB}, k AS (SELECT metadata_id, duration_ms % 12 + 1 AS a, duration_ms % 2 AS la, (duration_ms // 12) % 12 + 1 AS b, (duration_ms // 24) % 2 AS lb FROM lib)
SELECT metadata_id, CAST(coalesce(a = b OR (la = lb AND abs(a - b) IN (1, 11)), false) AS INTEGER) AS fits FROM k""",
    "q86_integrity_labels": f"""WITH s AS (SELECT metadata_id, CASE WHEN integrity_ok = 0 THEN concat_ws('; ', ({MESSAGES})[CAST(sample_rate % {len(MESSAGES)} + 1 AS INTEGER)], integrity_errors) ELSE '' END AS s FROM technical_features),
l AS (SELECT metadata_id, trim(s) AS s, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS l FROM s)
SELECT metadata_id, CASE WHEN s = '' THEN '' WHEN len(l) = 0 THEN 'unknown_error' ELSE array_to_string(l, ',') END AS labels FROM l""",
    "q87_json_lists": """WITH j AS (SELECT metadata_id, CASE WHEN json_valid(quality_issues) AND json_type(quality_issues) = 'ARRAY' THEN from_json(quality_issues, '["VARCHAR"]') ELSE [] END AS l FROM ml_features)
SELECT metadata_id, CAST(len(l) AS INTEGER) AS issues, coalesce(array_to_string(l, ','), '') AS joined FROM j""",
    "q88_tag_confidence": r"""SELECT id, round(CASE WHEN listeners % 101 > 0 THEN (listeners % 101) / 100 END, 6) AS confidence,
  CASE WHEN active_years IS NOT NULL THEN coalesce(try_cast(regexp_extract(active_years, '^\s*([+-]?\d+)', 1) AS INTEGER), 0) END AS since,
  CAST(CASE WHEN play_count IS NULL OR play_count = 0 THEN 1 ELSE play_count END AS BIGINT) AS plays FROM artist_stats""",
    "q89_probe_reports": "SELECT metadata_id, codec, bitrate, sample_rate, channels, metadata_id AS tag_title FROM technical_features",
    "q90_lastfm_tracks": "SELECT s.id, coalesce(listeners, 0) AS listeners, coalesce(play_count, 0) AS play_count, t.album, 1 AS tags, CAST(s.id % 100 AS INTEGER) AS first_count FROM artist_stats s JOIN tracks t USING (metadata_id) WHERE source = 'lastfm'",
    "q91_recordings": """WITH s AS (SELECT metadata_id, arg_max(struct_pack(c := country, y := active_years), id) AS s FROM artist_stats WHERE source = 'musicbrainz' GROUP BY 1)
SELECT t.metadata_id, t.title, 'ISRC' || right(t.metadata_id, 4) AS isrc, t.album, t.year AS date, s.s.c AS country, CASE WHEN s.s.y IS NOT NULL THEN substr(s.s.y, 1, 4) || '-present' END AS active_years FROM tracks t LEFT JOIN s USING (metadata_id)""",
    "q92_fingerprint_hits": """WITH t AS (SELECT * FROM tracks WHERE title <> '' AND artist <> '')
SELECT metadata_id AS k, 0.9::DOUBLE AS score, metadata_id AS recording_id, title, artist, album, metadata_id AS best FROM t UNION ALL SELECT metadata_id, 0.4::DOUBLE, 'x-' || metadata_id, title || ' (Live)', artist, album, metadata_id FROM t""",
    "q93_moved_paths": rf"""SELECT metadata_id, full_path || '.sidecar.json' AS sidecar,
  '/quarantine/' || CASE WHEN regexp_matches(full_path, '^[A-Za-z]:') THEN left(full_path, 1) || '/' || regexp_replace(replace(substr(full_path, 3), '\', '/'), '^/+', '') ELSE regexp_replace(replace(full_path, '\', '/'), '^/+', '') END AS mirrored,
  CASE WHEN regexp_matches(full_path, '^[A-Za-z]:\\') AND length(full_path) >= 260 THEN '\\?\' || full_path ELSE full_path END AS long_form, {_SAFE.format('full_path')} || '.opus' AS target FROM tracks""",
    "q94_durations": """SELECT metadata_id, CASE WHEN duration_ms IS NOT NULL THEN CAST(duration_ms // 60000 AS VARCHAR) || 'm ' || CAST((duration_ms // 1000) % 60 AS VARCHAR) || 's' END AS shown,
  strftime(analyzed_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp, '["' || codec || '", "x"]' AS listed, sha256(concat_ws('|', metadata_id, codec)) AS stable_id FROM technical_features""",
    "q95_feature_defaults": f"""WITH {LIB} SELECT metadata_id, CASE WHEN coalesce(bpm, 0) = 0 THEN 120.0::DOUBLE ELSE bpm END AS bpm, round(CASE WHEN coalesce(energy, 0) = 0 THEN 0.5::DOUBLE ELSE energy END, 6) AS energy,
  6.0::DOUBLE AS dynamic_range, 2.0::DOUBLE AS onsets, 0.1::DOUBLE AS rms, 'C' AS key, 'major' AS mode FROM lib""",
    "q96_signal_ranges": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), a AS (SELECT vec_id, v, list_transform(v, lambda x: abs(x)) AS l FROM v),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), s AS (SELECT vec_id, i, sum(x * x) OVER (PARTITION BY vec_id ORDER BY i) AS s, sum(x * x) OVER (PARTITION BY vec_id) AS t FROM u),
k AS (SELECT vec_id, CAST(min(i) - 1 AS BIGINT) AS cutoff FROM s WHERE s >= 0.995::DOUBLE * t GROUP BY 1)
SELECT a.vec_id, round(20 * log10(list_max(l) / greatest(list_avg(l), 1e-9::DOUBLE)), 4) AS db, round(len(list_filter(v, lambda x: x > 0)) / 4.0::DOUBLE, 6) AS onsets, cutoff FROM a JOIN k USING (vec_id)""",
}
