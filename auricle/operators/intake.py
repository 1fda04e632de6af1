"""Rows from exports, crawls and services on their way into the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.text import canonical_path
from auricle.operators import merge
from auricle.operators.pipeline import STAGES

SERVICE_PAGE = "items array<struct<track:struct<id:string,name:string,duration_ms:long,album:struct<name:string>,artists:array<struct<name:string>>>>>, next string"
SONG = "struct<id:string,title:string,artist:string,album:string,path:string>"


def first_of_files(rows: DataFrame, order: Column, path: str = "path", name: str = "filename") -> DataFrame:
    """One row per file, the first in order; rows without a file's name all stay."""
    filed = rows.where(F.coalesce(F.concat(F.col(path), F.col(name)), F.lit("")) != "")
    bare = rows.where(F.coalesce(F.concat(F.col(path), F.col(name)), F.lit("")) == "")
    return merge.first_per_key(filed, [path, name], [order]).unionByName(bare)


def with_overflow(cells: Column, n: int) -> Column:
    """The first ``n`` cells, the last of them with all further ones joined by ``; ``."""
    return F.when(F.size(cells) <= n, cells).otherwise(F.concat(F.slice(cells, 1, n - 1), F.array(F.array_join(F.slice(cells, n, F.size(cells)), "; "))))


def import_tracks(rows: DataFrame, tracks: DataFrame, key: str = "full_path") -> tuple[DataFrame, DataFrame]:
    """Rows with an unknown path, once each, and their jobs: one per stage, of which the import is done."""
    known = tracks.select(F.lower(key).alias("_k"))
    keyed = rows.where(F.col(key) != "").withColumn("_k", F.lower(key))
    fresh = merge.first_per_key(keyed, ["_k"], [F.col("metadata_id")]).join(known, "_k", "left_anti").drop("_k")
    stages = F.explode(F.array(*[F.lit(s) for s in STAGES]))
    jobs = fresh.select("metadata_id", stages.alias("stage")).withColumn("status", F.when(F.col("stage") == "import", "done").otherwise("pending")).withColumn("attempts", F.lit(0))
    return fresh, jobs


# --- song index ------------------------------------------------------------------------------


def crawled(pages: DataFrame, body: str, key: str = "song") -> DataFrame:
    """Songs of crawled pages, which hold one song or a list of them; a song that is met again counts once."""
    many = F.from_json(F.get_json_object(body, f"$.{key}"), f"array<{SONG}>")
    one = F.from_json(F.get_json_object(body, f"$.{key}"), SONG)
    listed = F.get_json_object(body, f"$.{key}").startswith("[")
    songs = pages.select(F.explode(F.when(listed, many).otherwise(F.array(one))).alias("s")).where("s.id != ''")
    first = songs.groupBy(F.col("s.id").alias("song_id")).agg(F.min(F.struct("s.path", "s.title", "s.artist", "s.album")).alias("s"))
    filled = [F.coalesce(f"s.{c}", F.lit("")).alias(c) for c in ("title", "artist", "album", "path")]
    return first.select("song_id", *filled)


def song_paths(songs: DataFrame) -> DataFrame:
    """(path_key, song_id): every path as it is, of which the last song counts, and without its first folder where that is no path itself."""
    whole = songs.select(canonical_path(F.col("path")).alias("path_key"), "song_id").where("path_key != ''")
    full = whole.groupBy("path_key").agg(F.max("song_id").alias("song_id"))
    short = whole.where(F.instr("path_key", "/") > 0).select(F.regexp_replace("path_key", r"^[^/]*/", "").alias("path_key"), "song_id")
    first = short.where("path_key != ''").groupBy("path_key").agg(F.min("song_id").alias("song_id"))
    return full.unionByName(first.join(full.select("path_key"), "path_key", "left_anti"))


def replace_part(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with the parts that ``fresh`` holds replaced whole."""
    return merge.delete_keys(cache, fresh.select(*keys).distinct(), keys).unionByName(merge.align(fresh, cache))


def read_through(cache: DataFrame, live: DataFrame, order: str) -> DataFrame:
    """The cache in order, or the live rows where it is empty."""
    return (live if cache.isEmpty() else cache).orderBy(order)


# --- playlists of services ---------------------------------------------------------------------


def service_items(pages: DataFrame, list_id: str, page: str, body: str) -> DataFrame:
    """(list_id, position, track_id, title, artist, album, duration_ms) of paged playlists; absent tracks are skipped, artists joined."""
    doc = F.from_json(body, SERVICE_PAGE)
    items = pages.select(list_id, page, F.posexplode(doc["items"]).alias("at", "i")).where("i.track is not null")
    names = F.array_join(F.transform("i.track.artists", lambda a: a["name"]), ", ")
    rows = items.select(
        list_id, page, "at", F.col("i.track.id").alias("track_id"), F.col("i.track.name").alias("title"), names.alias("artist"), F.col("i.track.album.name").alias("album"), F.col("i.track.duration_ms").alias("duration_ms")
    )
    return merge.compact(rows, list_id, "position", [F.col(page), F.col("at")]).drop(page, "at")


def create_import(confirmed: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and sizes of imported lists from (list_id, place, metadata_id).

    Rows without a track or a whole-numbered place are left out before places become positions; tracks that the library
    lacks leave a gap, and a track that is met again keeps its first position but counts.
    """
    rows = confirmed.where("metadata_id != '' and place is not null")
    placed = merge.compact(rows, "list_id", "position", [F.col("place"), F.col("metadata_id")])
    known = placed.join(tracks.select("metadata_id").distinct(), "metadata_id", "left_semi")
    members = known.groupBy("list_id", "metadata_id").agg(F.min("position").cast("long").alias("position"))
    return members, known.groupBy("list_id").agg(F.count("*").alias("track_count"))


def sure_matches(scored: DataFrame) -> DataFrame:
    """Matches of a search without those of a weak title and a weak artist at once."""
    return scored.where(~((F.col("title_score") < 90) & (F.col("artist_score") < 85)))
