"""Sinks: playlists as text, flat exports and sidecar documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def playlist_lines(members: DataFrame, by: str) -> DataFrame:
    """(by, body): the text of each playlist. Needs position, artist, title, duration_ms and full_path.

    One playlist is one text, so its lines meet in one row; null and empty names read ``Unknown``.
    """
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    seconds = F.coalesce((F.col("duration_ms") / 1000).cast("long"), F.lit(-1))
    info = F.concat(F.lit("#EXTINF:"), seconds.cast("string"), F.lit(","), unknown("artist"), F.lit(" - "), unknown("title"))
    lines = members.select(by, F.struct("position", F.concat_ws("\n", info, F.col("full_path")).alias("line")).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    return lines.groupBy(by).agg(F.concat(F.lit("#EXTM3U\n"), body).alias("body"))


def write_export(rows: DataFrame, path: str, form: str) -> None:
    """CSV with a fixed header, or JSON without null fields."""
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown form: {form}")


def write_partitioned(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON document a line from (id, payload), in files that appear only when they are whole."""
    rows.select("payload").write.mode("overwrite").text(path)


def byte_range(content: Column, header: Column) -> Column:
    """struct(status, start, stop, body) of a request for ``bytes=a-b`` of a file; a range outside it is not satisfiable."""
    size = F.length(content)
    first, last = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    start = F.when(first != "", first.try_cast("long")).otherwise(F.greatest(F.lit(0), size - last.try_cast("long")))
    stop = F.when((first != "") & (last != ""), F.least(last.try_cast("long"), size - 1)).otherwise(size - 1)
    whole = header.isNull() | (header == "")
    good = header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & (start <= stop) & (start < size)
    part = F.substr(content, (start + 1).cast("int"), (stop - start + 1).cast("int"))
    return F.struct(
        F.when(whole, 200).when(good, 206).otherwise(416).alias("status"), F.when(whole, 0).when(good, start).cast("long").alias("start"), F.when(whole, size - 1).when(good, stop).cast("long").alias("stop"), F.when(whole, content).when(good, part).alias("body")
    )
