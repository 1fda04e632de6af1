"""Plans, states and paths of files that are converted, moved or found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import paths

# Which original a converted file belongs to, best first (fixed values).
ORIGINALS = ["flac", "wav", "m4a", "aac", "mp3", "ogg", "wma"]


def profile(text: Column) -> Column:
    """struct(codec, kbps) from a report of ``key=value`` lines; unknown and 0 where it says nothing."""
    pairs = F.str_to_map(text, F.lit("\n"), F.lit("="))
    rate = F.try_element_at(pairs, F.lit("bit_rate")).try_cast("long")
    codec = F.nullif(F.trim(F.try_element_at(pairs, F.lit("codec_name"))), F.lit(""))
    return F.struct(F.coalesce(F.lower(codec), F.lit("unknown")).alias("codec"), F.coalesce(F.floor(rate / 1000), F.lit(0)).cast("int").alias("kbps"))


def state(source_size: Column, target_size: Column, code: Column, result_size: Column, stored: Column) -> Column:
    """struct(status, error) of one conversion from what its steps report.

    ``code`` is the encoder's exit code, ``result_size`` the size of what it wrote, ``stored`` whether that took its place.
    """
    failed = F.when(source_size.isNull(), "missing_source").when(code.isNull() | (code != 0), "encoder_failed").when(result_size.isNull(), "missing_output").when(result_size == 0, "empty_output").when(~stored, "finalize_failed")
    done = (target_size > 0) & source_size.isNotNull()
    return F.struct(
        F.when(done, "skipped_existing").when(failed.isNotNull(), "failed").otherwise("converted").alias("status"), F.when(~F.coalesce(done, F.lit(False)), failed).alias("error")
    )


def reconcile(tracks: DataFrame, files: DataFrame, suffix: str, root: str | None = None) -> DataFrame:
    """(metadata_id, status, full_path): tracks whose converted file exists below ``root`` take its path."""
    path = paths.slashed(F.col("full_path"))
    target = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", f".{suffix}")
    inside = F.lit(True) if root is None else target.startswith(root.rstrip("/") + "/")
    there = files.select(paths.slashed(F.col("path")).alias("_target"), F.lit(True).alias("_there")).distinct()
    joined = tracks.withColumn("_target", target).join(there, "_target", "left")
    status = F.when(F.lower(path).endswith("." + suffix), "already").when(F.col("_there") & inside, "updated").otherwise("missing")
    return joined.withColumn("status", status).select("metadata_id", "status", F.when(F.col("status") == "updated", F.col("_target")).otherwise(F.col("full_path")).alias("full_path"))


def sibling_sources(files: DataFrame, suffix: str) -> DataFrame:
    """(path, source): for each file of ``suffix`` the file of the same name it was made from, by the kind's rank and then the name."""
    keyed = files.select(paths.slashed(F.col("path")).alias("path")).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    keyed = keyed.withColumn("stem", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")).where("kind != ''")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in ORIGINALS]), F.col("kind")), F.lit(0)), F.lit(100))
    best = keyed.where(F.col("kind") != suffix).groupBy("stem").agg(F.min_by("path", F.struct(rank, F.lower("path"))).alias("source"))
    return keyed.where(F.col("kind") == suffix).join(best, "stem").select("path", "source")


def companions(files: DataFrame, audio: tuple[str, ...]) -> DataFrame:
    """(path, companion): files of other kinds with the folder and name of an audio file."""
    keyed = files.select(paths.slashed(F.col("path")).alias("path")).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("stem", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""))
    other = keyed.where(~F.col("kind").isin(*audio)).select("stem", F.col("path").alias("companion"))
    return keyed.where(F.col("kind").isin(*audio)).join(other, "stem").select("path", "companion")


def moves(rows: DataFrame, root: str) -> DataFrame:
    """(metadata_id, source, target, status): where files go below ``root``; files that are there already stay, two that would meet are conflicts."""
    target = paths.mirrored(F.col("full_path"), root)
    planned = rows.where("full_path != ''").select("metadata_id", F.col("full_path").alias("source"), target.alias("target"))
    many = F.count("*").over(Window.partitionBy("target"))
    status = F.when(paths.slashed(F.col("source")).startswith(root.rstrip("/") + "/"), "in_place").when(many > 1, "conflict").otherwise("move")
    return planned.withColumn("status", status)


def inventory(tracks: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every track with its sidecar's path, in the order of paths."""
    return tracks.select("metadata_id", "full_path").join(sidecars.select("metadata_id", "sidecar_path"), "metadata_id", "left").orderBy("full_path", "metadata_id")


def relocate(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """Tracks with the new paths of ``found`` (metadata_id, path): folder, file name and whole path are set together."""
    new = found.where("path != ''").groupBy("metadata_id").agg(F.min("path").alias("_path"))
    joined = tracks.join(new, "metadata_id", "left")
    parts = {"full_path": F.col("_path"), "filename": F.regexp_extract("_path", r"([^\\/]*)$", 1), "file_path": F.regexp_replace("_path", r"[^\\/]*$", "")}
    return joined.select(*[F.when(F.col("_path").isNotNull(), parts[c]).otherwise(F.col(c)).alias(c) if c in parts else F.col(c) for c in tracks.columns])


def latest(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows changed last, newest first."""
    return rows.orderBy(F.desc(by), key).limit(n)


def sidecar_payloads(tracks: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """(metadata_id, payload): documents to write; a document's first stamp stays, the second one is now."""
    known = old.select("metadata_id", F.col("created_at").alias("_created"))
    joined = tracks.join(known, "metadata_id", "left")
    body = F.struct(F.lit(1).alias("v"), F.col("metadata_id").alias("id"), F.col("full_path").alias("path"), F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))
    return joined.select("metadata_id", F.to_json(body).alias("payload"))


def writeback_audit(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """(metadata_id, field, old_value, new_value) of tags that would change; both tables hold one row per track."""
    pick = lambda df, name: df.select("metadata_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])).alias("x")).select("metadata_id", "x.*")
    met = pick(new, "new_value").where("new_value is not null").join(pick(old, "old_value"), ["metadata_id", "field"], "left")
    return met.where(~F.col("new_value").eqNullSafe(F.col("old_value"))).select("metadata_id", "field", "old_value", "new_value")


def retry_stage(jobs: DataFrame, stage: str) -> DataFrame:
    """All jobs of a stage that are not running return to pending with no attempts."""
    hit = (F.col("stage") == stage) & (F.col("status") != "running")
    return jobs.withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).withColumn("attempts", F.when(hit, F.lit(0)).otherwise(F.col("attempts")))


def reopen(jobs: DataFrame, stage: str, gaps: DataFrame, key: str = "metadata_id") -> DataFrame:
    """Done jobs of a stage whose subject has gaps return to pending."""
    open_again = gaps.select(key).distinct().withColumn("_gap", F.lit(True))
    hit = (F.col("stage") == stage) & (F.col("status") == "done") & F.coalesce("_gap", F.lit(False))
    return jobs.join(open_again, key, "left").withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).select(*jobs.columns)


def seen_paths(files: DataFrame, excluded: list[str]) -> DataFrame:
    """Files outside the excluded folders, by whole folder names and without case."""
    words = [e.replace("\\", "/").strip("/").lower() for e in excluded if e.strip("\\/ ")]
    lowered = F.lower(paths.slashed(F.col("path")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.concat(F.lit("/"), lowered), F.lit(f"/{w}/"))
    return files.where(~hit)
