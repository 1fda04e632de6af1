"""Orders, presets, arcs and curated lists; streams that are drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auricle.io import load, new_path
from auricle.operators import playlist, search
from auricle.plans.library import GROUPS, LIB, deduped, grouped_library, library
from auricle.streaming import jobs as streams

c = F.col
ORDERS = ["popularity", "bpm", "energy_asc", "energy_desc", "year", "danceability", "random"]
PRESETS = ["bpm_asc", "bpm_desc", "energy_asc", "energy_desc", "key_asc", "key_desc", "genre", "artist"]
NARROW = {"bpm_min": 90, "bpm_max": 160, "year_min": 1980, "year_max": 2015}


def q133_custom_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty of a custom playlist in each order."""
    rows = grouped_library(spark, d)
    lists = [playlist.generate("custom", rows, {**NARROW, "sort_by": o, "limit": 30}).select(F.lit(o).alias("list_name"), "metadata_id", c("position").cast("long").alias("position")) for o in ORDERS]
    out = lists[0]
    for other in lists[1:]:
        out = out.unionByName(other)
    return out


def q134_view_presets(spark: SparkSession, d: str) -> DataFrame:
    """The place of each track inside its genre in every view."""
    rows = library(spark, d).where("genre_primary is not null")
    rank = lambda name: F.row_number().over(Window.partitionBy("genre_primary").orderBy(*search.preset(name))).cast("long").alias(name)
    return rows.select("metadata_id", *[rank(p) for p in PRESETS])


def q135_custom_arc(spark: SparkSession, d: str) -> DataFrame:
    return playlist.generate("custom", grouped_library(spark, d), {**NARROW, "sort_by": "energy_arc", "limit": 40}).select("metadata_id", "energy", c("position").cast("long").alias("position"))


def _curated(spark: SparkSession, d: str, specs: list[dict]) -> DataFrame:
    ml = load(spark, d, "ml_features").select("metadata_id", "acousticness", F.lit(True).alias("classified"))
    rows = grouped_library(spark, d).join(ml, "metadata_id", "left").withColumn("classified", F.coalesce("classified", F.lit(False)))
    tags = load(spark, d, "artist_stats").where("source = 'lastfm'").select("metadata_id", F.explode(F.split("genres", r"\s*[,;|/]\s*")).alias("tag"))
    out = None
    for spec in specs:
        one = playlist.curated(rows, spec, tags).select("metadata_id", "list_name", c("position").cast("long").alias("position"))
        out = one if out is None else out.unionByName(one)
    return out


def q136_curated_lists(spark: SparkSession, d: str) -> DataFrame:
    """The curated lists in the order of tempo or as an arc."""
    return _curated(spark, d, [s for s in playlist.SPECS if s["sort"] != "harmonic"])


def q137_curated_chains(spark: SparkSession, d: str) -> DataFrame:
    """The curated lists in harmonic order, whose greedy walk has no SQL."""
    return _curated(spark, d, [s for s in playlist.SPECS if s["sort"] == "harmonic"])


def q138_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts of closed windows of the events as a stream."""
    events = streams.table_stream(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    counted = streams.windowed_counts(events, "10 minutes", "1 hour")
    return streams.collected(counted, new_path(spark), new_path(spark)).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def q139_stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of a job of each customer: its last status and its failures."""
    o = streams.table_stream(spark, d, "orders")
    status = F.when(c("o_orderstatus") == "F", "done").when(c("o_orderstatus") == "O", "pending").otherwise("failed")
    events = o.select(c("o_custkey").cast("string").alias("id"), c("o_orderkey").alias("seq"), status.alias("status"))
    out = streams.collected(streams.job_states(events, None), new_path(spark), new_path(spark), "update")
    return out.groupBy("id").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s")).select("id", "s.status", "s.attempts")


def q140_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Statistics as a stream that is read twice: every track once in the table."""
    path, seen = new_path(spark), new_path(spark)
    stream = lambda: streams.table_stream(spark, d, "artist_stats").select("metadata_id")
    streams.once(stream(), ["metadata_id"], path, seen)
    streams.once(stream(), ["metadata_id"], path, seen)
    return spark.read.schema("metadata_id string").parquet(path)


QUERIES = {
    f.__name__: f
    for f in (
        q133_custom_orders, q134_view_presets, q135_custom_arc, q136_curated_lists, q137_curated_chains, q138_stream_windows, q139_stream_job_states, q140_stream_ingest,
    )
}

_YEAR = "coalesce(try_cast(regexp_extract(substr(year, 1, 4), '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0)"
_NARROW = f"bpm >= 90 AND bpm <= 160 AND year <> '' AND {_YEAR} >= 1980 AND {_YEAR} <= 2015"
_SORT = {
    "popularity": "coalesce(listeners, 0) DESC", "bpm": "coalesce(bpm, 9999)", "energy_asc": "coalesce(energy, 0)", "energy_desc": "coalesce(energy, 0) DESC", "year": "coalesce(year, '')",
    "danceability": "coalesce(danceability, 0) DESC", "random": "md5(metadata_id || '0')",
}
_NUMBER = "CASE WHEN regexp_matches(camelot_key, '^\\d+[A-Za-z]$') THEN CAST(regexp_extract(camelot_key, '^(\\d+)', 1) AS INTEGER) ELSE 99 END"
_LETTER = "CASE WHEN regexp_matches(camelot_key, '^\\d+[A-Za-z]$') THEN right(camelot_key, 1) ELSE 'Z' END"
_PRESET = {
    "bpm_asc": "bpm NULLS FIRST", "bpm_desc": "bpm DESC NULLS LAST", "energy_asc": "energy NULLS FIRST", "energy_desc": "energy DESC NULLS LAST", "key_asc": f"{_NUMBER}, {_LETTER}", "key_desc": f"{_NUMBER} DESC, {_LETTER} DESC",
    "genre": "lower(genre_primary) NULLS FIRST", "artist": "lower(artist) NULLS FIRST",
}


def _spec_sql(spec: dict) -> str:
    """One curated list as SQL."""
    get, where = spec.get, ["bpm IS NOT NULL", "energy IS NOT NULL", "metadata_id IN (SELECT metadata_id FROM ml_features)"]
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    if get("genres"):
        where.append(f"genre_primary IN ({quoted(spec['genres'])})")
    if get("include_moods"):
        where.append("(" + " OR ".join(f"mood_tags ILIKE '%{m}%'" for m in spec["include_moods"]) + ")")
    where += [f"(mood_tags IS NULL OR NOT mood_tags ILIKE '%{m}%')" for m in get("exclude_moods") or []]
    for name, column in (("bpm", "bpm"), ("energy", "energy"), ("danceability", "danceability"), ("confidence", "genre_confidence")):
        where += [f"{column} {op} {spec[key]}" for op, key in ((">=", f"{name}_min"), ("<=", f"{name}_max")) if get(key)]
    for op, name in ((">=", "acousticness_min"), ("<=", "acousticness_max")):
        if get(name):
            where.append(f"metadata_id IN (SELECT metadata_id FROM ml_features WHERE acousticness {op} {spec[name]})")
    if get("min_popularity"):
        where.append(f"coalesce(listeners, 0) >= {spec['min_popularity']}")
    if get("decades"):
        where.append(f"CAST(CAST(floor(try_cast(substr(year, 1, 4) AS INTEGER) / 10) * 10 AS INTEGER) AS VARCHAR) || 's' IN ({quoted(spec['decades'])})")
    if get("tags"):
        where.append(rf"metadata_id IN (SELECT metadata_id FROM (SELECT metadata_id, unnest(regexp_split_to_array(genres, '\s*[,;|/]\s*')) AS tag FROM artist_stats WHERE source = 'lastfm') WHERE lower(tag) IN ({quoted(spec['tags'])}))")
    n = spec["limit"]
    pool = f"SELECT lib.*, row_number() OVER (PARTITION BY coalesce(remix_group, metadata_id) ORDER BY metadata_id) AS rn FROM lib JOIN remix USING (metadata_id) WHERE {' AND '.join(where)}"
    if get("popular"):
        chosen = f"SELECT * FROM ({pool}) WHERE rn = 1 ORDER BY coalesce(listeners, 0) DESC, metadata_id LIMIT {n}"
    else:
        chosen = f"SELECT * FROM (SELECT * FROM ({pool}) WHERE rn = 1 ORDER BY coalesce(genre_confidence, 0) DESC, metadata_id LIMIT {3 * n}) ORDER BY md5(metadata_id || '42'), metadata_id LIMIT {n}"
    if spec["sort"] == "bpm":
        return f"SELECT metadata_id, '{spec['name']}' AS list_name, row_number() OVER (ORDER BY bpm, metadata_id) AS position FROM ({chosen})"
    at = f"SELECT metadata_id, row_number() OVER (ORDER BY energy, metadata_id) AS i, count(*) OVER () AS n FROM ({chosen})"
    return f"SELECT metadata_id, '{spec['name']}' AS list_name, CAST(CASE WHEN i <= CAST(floor(n * 0.6) AS BIGINT) THEN i ELSE n + CAST(floor(n * 0.6) AS BIGINT) + 1 - i END AS BIGINT) AS position FROM ({at})"


ORACLE = {
    "q133_custom_orders": " UNION ALL ".join(f"SELECT '{name}' AS list_name, metadata_id, position FROM ({deduped(_NARROW, order, 30, 'metadata_id')})" for name, order in _SORT.items()),
    "q134_view_presets": f"WITH {LIB} SELECT metadata_id, " + ", ".join(f"row_number() OVER (PARTITION BY genre_primary ORDER BY {order}, metadata_id) AS {name}" for name, order in _PRESET.items()) + " FROM lib WHERE genre_primary IS NOT NULL",
    "q135_custom_arc": f"""WITH top AS ({deduped(_NARROW, "coalesce(listeners, 0) DESC", 40, "metadata_id, energy")}), a AS (SELECT metadata_id, energy, row_number() OVER (ORDER BY coalesce(energy, 0), metadata_id) AS i, count(*) OVER () AS n FROM top)
SELECT metadata_id, energy, CAST(CASE WHEN i <= CAST(floor(n * 0.6) AS BIGINT) THEN i ELSE n + CAST(floor(n * 0.6) AS BIGINT) + 1 - i END AS BIGINT) AS position FROM a""",
    "q136_curated_lists": f"WITH {LIB}, {GROUPS} " + " UNION ALL ".join(f"SELECT * FROM ({_spec_sql(s)})" for s in playlist.SPECS if s["sort"] != "harmonic"),
    "q138_stream_windows": """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    "q139_stream_job_states": """SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END, o_orderkey) AS status,
  CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS INTEGER) AS attempts FROM orders GROUP BY 1""",
    "q140_stream_ingest": "SELECT DISTINCT metadata_id FROM artist_stats",
}
