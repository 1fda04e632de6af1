"""Lists and their members: lookup, append, clone, delete, counts, export tags, synchronization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.text import canonical_path
from auricle.operators import merge


def resolve_list(lists: DataFrame, wanted: str) -> DataFrame:
    """The list with this id, or else the newest one of exactly this name."""
    hit = lists.where((F.col("list_id").cast("string") == F.lit(wanted)) | (F.col("name") == F.lit(wanted)))
    return hit.orderBy((F.col("list_id").cast("string") == F.lit(wanted)).desc(), F.desc("created_at"), "list_id").limit(1)


def overview(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Every list with its number of members, also where it has none; members are counted before the join."""
    counts = members.groupBy("list_id").agg(F.count("*").alias("members"))
    return lists.join(counts, "list_id", "left").withColumn("members", F.coalesce("members", F.lit(0)))


def append(members: DataFrame, new: DataFrame) -> DataFrame:
    """New (list_id, item_id) at the end of their lists; items that a list holds are ignored."""
    last = members.groupBy("list_id").agg(F.max("position").alias("last"))
    fresh = new.dropDuplicates(["list_id", "item_id"]).join(members.select("list_id", "item_id"), ["list_id", "item_id"], "left_anti")
    placed = merge.compact(fresh.withColumn("position", F.lit(0)), "list_id", "position", [F.col("item_id")]).join(last, "list_id", "left")
    placed = placed.select("list_id", "item_id", (F.col("position") + F.coalesce("last", F.lit(0))).cast("long").alias("position"))
    return members.select("list_id", "item_id", F.col("position").cast("long").alias("position")).unionByName(placed)


def clone(members: DataFrame, source: int, target: int) -> DataFrame:
    """Members of ``source`` under the id ``target``."""
    return members.where(F.col("list_id") == source).withColumn("list_id", F.lit(target).cast(members.schema["list_id"].dataType))


def delete_lists(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the deleted lists."""
    return [merge.delete_keys(t, gone, ["list_id"]) for t in tables]


def outside(rows: DataFrame, path: str, folders: list[str]) -> DataFrame:
    """Rows whose path lies in none of the folders; whole path parts, without case."""
    p = canonical_path(F.col(path))
    norms = [f.replace("\\", "/").strip("/").lower() for f in folders]
    hit = reduce(lambda a, f: a | (p == f) | p.startswith(f + "/"), norms, F.lit(False))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def cache_key(kind: str, key: Column) -> Column:
    """struct(artist, title) of ``kind:artist:title``; the last colon separates."""
    pattern = rf"^{kind}:(.*):([^:]*)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("artist"), F.regexp_extract(key, pattern, 2).alias("title"))


def writeback_tags(library: DataFrame, genres: DataFrame) -> DataFrame:
    """Tags to write: tempo as a whole number (half to even), wheel key, first genre by id. ``genres`` is (metadata_id, seq, genre)."""
    first = genres.groupBy("metadata_id").agg(F.min_by("genre", "seq").alias("genre_tag"))
    return library.join(first, "metadata_id", "left").select(
        "metadata_id", F.bround("bpm", 0).cast("int").cast("string").alias("bpm_tag"), F.col("camelot_key").alias("key_tag"), "genre_tag"
    )


def sync_plan(members: DataFrame, resolved: DataFrame, blocked: DataFrame) -> DataFrame:
    """(list_id, song_id, position): resolved members in order, without blocked items; a song stays at its first place."""
    rows = members.join(blocked.select("item_id"), "item_id", "left_anti").join(resolved, "item_id")
    first = rows.groupBy("list_id", "song_id").agg(F.min("position").alias("position"))
    return merge.compact(first, "list_id", "position", [F.col("position"), F.col("song_id")])


# Floors of the popularity tiers of a form; the lowest tier filters nothing (fixed values).
FLOORS = {"listeners": {"niche": 0, "mainstream": 1_000, "viral": 100_000}, "play_count": {"niche": 0, "mainstream": 10_000, "viral": 1_000_000}}


def form_params(form: dict) -> dict:
    """Parameters of a custom playlist from a form: percents to shares, tiers to floors, a mood on one side only."""
    out = {k: v for k, v in form.items() if v not in (None, "", [])}
    for k in ("energy_min", "energy_max", "danceability_min", "danceability_max", "confidence_min", "confidence_max"):
        if k in out:
            out[k] = out[k] / 100
    tier = out.pop("tier", None)
    if tier:
        out["min_popularity"] = FLOORS[out.get("metric", "listeners")][tier]
    kept = set(out.get("include_moods", []))
    out["exclude_moods"] = [m for m in out.get("exclude_moods", []) if m not in kept]
    out["genres"] = [g for g in out.get("genres", []) if g != "unknown"]
    return out
