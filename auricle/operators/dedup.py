"""Exact, fuzzy and remix-level duplicates, and the assignment of group ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.similarity import in_order, letters, parities, places
from auricle.functions.text import base_title
from auricle.io import materialize
from auricle.operators.selection import star_clusters

THRESHOLD = 0.85
GAP_MS = 5000
#: Rows of one side of a cell.
BLOCK = 8000
#: Rows of the cells that a task takes at once, and pairs of them in memory at once.
BUCKET, PAIRS = 40_000, 1_000_000
#: Roles of a row in a cell: left and right ones meet, mutual ones are left and meet each other as well; whole ones are all of an artist.
RIGHT, LEFT, MUTUAL, WHOLE = 0, 1, 2, 3
#: Hashes that are sent to all executors; where there are more, rows are joined to them.
FEW = 500_000


def partial_key(text: Column, size: int = 64) -> Column:
    """Digest of the first and last ``size`` characters, of the whole where it is short."""
    ends = F.concat(F.substr(text, F.lit(1), F.lit(size)), F.right(text, F.lit(size)))
    return F.sha2(F.when(F.length(text) <= 2 * size, text).otherwise(ends), 256)


def hash_groups(rows: DataFrame, key: str, digest: Column) -> DataFrame:
    """(digest, members, first) of digests that two rows or more share; null and empty digests do not count."""
    return (
        rows.select(F.col(key).alias("id"), digest.alias("digest"))
        .where("digest is not null and digest != ''")
        .groupBy("digest")
        .agg(F.count("*").alias("members"), F.min("id").alias("first"))
        .where("members > 1")
    )


def repeated(rows: DataFrame, keys: dict[str, list[Column]]) -> DataFrame:
    """``rows`` with a column by name of a key: whether another row has the same hash of it, so that only these can share the key.

    Where most rows are like no other, few are left to be grouped by whole keys.
    """
    hashed = {name: F.xxhash64(F.lit(name), *key) for name, key in keys.items()}
    counts = rows.select(F.explode(F.array(*hashed.values())).alias("hash")).groupBy("hash").count()
    many = materialize(counts.where("count > 1").select("hash"))
    few = many.count() <= FEW
    out = rows
    for name, value in hashed.items():
        side = many.select("hash", F.lit(True).alias("_again"))
        out = out.withColumn("hash", value).join(F.broadcast(side) if few else side, "hash", "left")
        out = out.select(*rows.columns, *[n for n in keys if n in out.columns], F.col("_again").isNotNull().alias(name))
    return out if few else materialize(out)


def partial_groups(rows: DataFrame, key: str, full: Column, partial: Column) -> DataFrame:
    """Groups by the partial digest among rows that no full digest groups; two or more must be left."""
    grouped = hash_groups(rows, key, full).select("digest")
    rest = rows.withColumn("digest", full).join(grouped, "digest", "left_anti").drop("digest")
    return hash_groups(rest, key, partial)


def remix_keys(tracks: DataFrame, *more: str | Column) -> DataFrame:
    """(metadata_id, artist_key, base_key) and ``more``: the act and the composition of every track."""
    return tracks.select("metadata_id", F.lower(F.trim("artist")).alias("artist_key"), F.lower(base_title(F.col("title"))).alias("base_key"), *more)


def remix_groups(tracks: DataFrame) -> DataFrame:
    """(artist_key, base_key, members, first) of compositions with two tracks or more."""
    return composition_groups(remix_keys(tracks))


def composition_groups(keys: DataFrame) -> DataFrame:
    """The groups of ``remix_groups`` from the columns of ``remix_keys``."""
    return (
        keys.where("artist_key != '' and base_key != ''")
        .groupBy("artist_key", "base_key")
        .agg(F.count("*").alias("members"), F.min("metadata_id").alias("first"))
        .where("members > 1")
    )


def windows(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all places lo to hi of every row, some million at once."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        m = n[start:stop]
        row = np.repeat(np.arange(start, stop), m)
        yield row, np.arange(len(row)) + np.repeat(lo[start:stop] - (np.cumsum(m) - m), m)
        start = stop


def meet(bits: tuple[np.ndarray, np.ndarray], room: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of the places lo to hi, which grow by row, whose bits differ in no more than the room of both.

    Where a row has many places, some rows are compared with all places of any of them at once.
    """
    (a, b), (x, y) = bits, room
    if np.maximum(hi - lo, 0).sum() < 32 * len(lo):
        for row, place in windows(lo, hi):
            keep = np.bitwise_count(a[row] ^ b[place]) <= x[row] + y[place]
            yield row[keep], place[keep]
        return
    start = 0
    while start < len(lo):
        stop = start + max(1, min(64, PAIRS // max(1, int(hi[start] - lo[start]))))
        first, last = lo[start:stop].min(), hi[start:stop].max()
        most = np.minimum(x[start:stop].max() + y[first:last], 64).astype(np.uint8)
        row, place = np.nonzero(np.bitwise_count(a[start:stop, None] ^ b[first:last]) <= most)
        row, place = row + start, place + first
        keep = (lo[row] <= place) & (place < hi[row])
        row, place = row[keep], place[keep]
        keep = np.bitwise_count(a[row] ^ b[place]) <= x[row] + y[place]
        yield row[keep], place[keep]
        start = stop


def _similar(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of cells: upper bounds by length, duration, characters and pairs of characters first, then the exact ratio.

    Of T letters of two texts at most (1 - least) T are not matched. The matched ones lie in no more than that number of
    blocks and one, so at most three times as many pairs of neighbours are not common.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, artists, titles = pdf["metadata_id"].to_numpy(), pdf["artist_key"].to_numpy(), pdf["key"].tolist()
        ms, role = pdf["duration_ms"].to_numpy(dtype="float64", na_value=np.nan), pdf["role"].to_numpy()
        size, points, at = letters(titles)
        chars = parities(len(titles), at, points, 1)[:, 0]
        inner = at[1:] == at[:-1]
        pairs = parities(len(titles), at[1:][inner], points[:-1][inner] << np.uint64(21) | points[1:][inner], 4)
        counts = np.bincount(at * 64 + (points % np.uint64(64)).astype(np.int64), minlength=64 * len(titles)).reshape(-1, 64)
        room = size * (1 - least) + 5e-7
        # cells and lengths in one number, so that the rows of a cell whose lengths allow it stand together
        width = int(size.max()) + 2
        code = np.unique(pdf["cell"].to_numpy(), return_inverse=True)[1].astype(np.int64) * width
        low = code + np.maximum(np.ceil(size * least / (2 - least) - 1e-6).astype(np.int64), 0)
        high = code + np.minimum(np.floor(size * (2 - least) / least + 1e-6).astype(np.int64), width - 1)
        spot = code + size
        by = np.argsort(spot, kind="stable")
        left, right, mutual = by[role[by] != RIGHT], by[role[by] == RIGHT], by[role[by] == MUTUAL]
        whole = by[role[by] == WHOLE]
        blank, timed = whole[np.isnan(ms[whole])], whole[~np.isnan(ms[whole])]
        left = left[role[left] != WHOLE]
        # of an artist as a whole, rows of known durations meet within the gap, by cell and rank of the duration
        times, rank = np.unique(ms[timed], return_inverse=True)
        base = code[timed] // width * len(times)
        order = np.argsort(base + rank, kind="stable")
        last = (base + np.searchsorted(times, ms[timed] + GAP_MS, side="right"))[order]
        base, timed = (base + rank)[order], timed[order]
        below = lambda mine, theirs: np.searchsorted(spot[theirs], low[mine], side="left")
        above = lambda mine, theirs: np.searchsorted(spot[theirs], high[mine], side="right")
        found: set[tuple[str, str]] = set()
        for mine, theirs, lo, hi in (
            (left, right, below(left, right), above(left, right)),
            (mutual, mutual, np.arange(1, len(mutual) + 1), above(mutual, mutual)),
            (blank, whole, below(blank, whole), above(blank, whole)),
            (timed, timed, np.arange(1, len(timed) + 1), np.searchsorted(base, last, side="left")),
        ):
            for row, place in meet((chars[mine], chars[theirs]), (room[mine], room[theirs]), lo, hi):
                i, j = mine[row], theirs[place]
                gap = np.abs(ms[i] - ms[j])
                keep = np.isnan(gap) | (gap <= GAP_MS)
                i, j = i[keep], j[keep]
                keep = np.bitwise_count(pairs[i] ^ pairs[j]).sum(1, dtype=np.int64) <= 3 * (room[i] + room[j])
                i, j = i[keep], j[keep]
                keep = np.abs(counts[i] - counts[j]).sum(1) <= room[i] + room[j]
                for x, y in zip(i[keep].tolist(), j[keep].tolist()):
                    if ids[x] == ids[y] or artists[x] != artists[y]:
                        continue
                    if ids[y] < ids[x]:
                        x, y = y, x
                    a, b = titles[x], titles[y]
                    if a == b or 2 * in_order(places(a), len(a), b) >= least * (len(a) + len(b)) and SequenceMatcher(None, a, b).ratio() >= least:
                        found.add((ids[x], ids[y]))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype=object)

    return run


def _keyed(tracks: DataFrame) -> DataFrame:
    return tracks.select(
        "metadata_id", F.lower(F.trim("artist")).alias("artist_key"), F.lower(F.trim("title")).alias("key"), "duration_ms"
    ).where("artist_key != '' and key != ''")


def _cells(rows: DataFrame, least: float) -> DataFrame:
    """``rows`` with role, cell: pairs of a left and a right row, of mutual and of whole rows, of one cell are all that can be similar.

    An artist of few rows is a cell, which has each row once. Those of others are an artist's spans of durations, in which a
    row meets those of its own and of the next span, and its spans of lengths, in which a row meets unknown durations. Cells
    of many rows are cut by hash into a grid of bounded ones.
    """
    artist = F.xxhash64("artist_key").alias("artist")
    # stored, so Spark knows that they are small
    great = materialize(rows.select(artist).groupBy("artist").count().where(F.col("count") > BLOCK).select("artist"))
    span = F.floor(F.col("duration_ms") / GAP_MS).cast("long")
    band = F.floor(F.log(F.length("key")) / (float(np.log((2 - least) / least)) + 1e-6)).cast("long")
    place = lambda kind, at, role: F.struct(F.lit(kind).alias("kind"), at.alias("at"), F.lit(role).alias("role"))
    known = F.array(place(0, span, MUTUAL), place(0, span - 1, RIGHT), place(1, band, LEFT))
    unknown = F.array(place(1, band, LEFT), *[place(1, band + k, RIGHT) for k in (-1, 0, 1)])
    told = rows.withColumn("artist", artist).join(great.withColumn("great", F.lit(True)), "artist", "left")
    whole = F.array(place(2, F.lit(0).cast("long"), WHOLE))
    met = told.withColumn("p", F.explode(F.when(F.col("great").isNull(), whole).when(F.col("duration_ms").isNull(), unknown).otherwise(known)))
    met = met.select(*rows.columns, "p.role", F.xxhash64("artist_key", "p.kind", "p.at").alias("cell"))
    cuts = lambda own: F.greatest(F.lit(1), F.ceil(F.count(F.when(own, 1)) / BLOCK)).cast("int")
    large = materialize(met.where(F.col("role") != WHOLE).groupBy("cell").agg(cuts(F.col("role") != RIGHT).alias("height"), cuts(F.col("role") == RIGHT).alias("width")).where("height > 1 or width > 1"))
    grid = f"""CASE WHEN height IS NULL THEN array(struct(0 AS row, 0 AS col, role AS part))
      WHEN role = {RIGHT} THEN transform(sequence(0, height - 1), r -> struct(r AS row, own AS col, {RIGHT} AS part))
      ELSE concat(transform(sequence(0, width - 1), c -> struct(own AS row, c AS col, IF(c = 0, role, {LEFT}) AS part)),
        IF(role = {MUTUAL}, transform(filter(sequence(0, height - 1), c -> c < own), c -> struct(own AS row, -1 - c AS col, {LEFT} AS part)), array()),
        IF(role = {MUTUAL}, transform(filter(sequence(0, height - 1), r -> r > own), r -> struct(r AS row, -1 - own AS col, {RIGHT} AS part)), array())) END"""
    split = met.join(large, "cell", "left").withColumn("own", F.pmod(F.xxhash64("metadata_id"), F.when(F.col("role") == RIGHT, F.col("width")).otherwise(F.col("height"))).cast("int"))
    out = split.withColumn("g", F.explode(F.expr(grid)))
    return out.select(*rows.columns, F.col("g.part").alias("role"), F.xxhash64("cell", "g.row", "g.col").alias("cell"))


def similar_pairs(tracks: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(a, b), a before b: tracks of one artist with similar titles and durations at most 5 s apart or unknown.

    Rows meet in cells of bounded size, and tasks take buckets of cells, so neither an artist with a third of all rows nor
    many artists with few rows cost more than their comparisons.
    """
    return _pairs(materialize(_keyed(tracks)), least)


def _pairs(rows: DataFrame, least: float) -> DataFrame:
    buckets = F.lit(max(rows.sparkSession.sparkContext.defaultParallelism, 2 * rows.count() // BUCKET))
    met = _cells(rows, least).withColumn("bucket", F.pmod("cell", buckets))
    return met.groupBy("bucket").applyInPandas(_similar(least), "a string, b string").distinct()


def fuzzy_duplicates(tracks: DataFrame) -> DataFrame:
    """(seed, member): star clusters in id order; membership is not transitive.

    Rows of equal artist, title and duration have the same neighbours and each other, so the first one stands for them: it
    takes the others as a seed, and a seed that takes it takes them too.
    """
    rows = materialize(_keyed(tracks))
    alike = ["artist_key", "key", "duration_ms"]
    told = repeated(rows, {"alike": [F.col(c) for c in alike]})
    single, others = told.where("not alike").drop("alike"), told.where("alike")
    first = materialize(others.groupBy(*alike).agg(F.min("metadata_id").alias("first"), F.count("*").alias("n")))
    stars = star_clusters(_pairs(single.unionByName(first.select(F.col("first").alias("metadata_id"), *alike)), THRESHOLD))
    f = first.where("n > 1").select("first", *[F.col(c).alias(f"_{c}") for c in alike])
    same = others.join(f, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).where("metadata_id != first").select("first", F.col("metadata_id").alias("twin"))
    seeds = stars.select("seed", F.col("member").alias("first"))
    twins = same.join(seeds, "first", "left").select(F.coalesce("seed", "first").alias("seed"), F.col("twin").alias("member"))
    return stars.unionByName(twins)


def assign_groups(signals: DataFrame, full: DataFrame, partial: DataFrame, fuzzy: DataFrame, remix: DataFrame, clear: bool = False) -> DataFrame:
    """New duplicate_group and remix_group; fuzzy groups win over partial and full ones. Inputs are (metadata_id, group_id).

    Old ids stay where nothing new is found, unless ``clear``.
    """
    out = signals
    for name, groups in (("full", full), ("partial", partial), ("fuzzy", fuzzy), ("remix", remix)):
        out = out.join(groups.select("metadata_id", F.col("group_id").alias(name)), "metadata_id", "left")
    old_d, old_r = (F.lit(None), F.lit(None)) if clear else (F.col("duplicate_group"), F.col("remix_group"))
    return (
        out.withColumn("duplicate_group", F.coalesce("fuzzy", "partial", "full", old_d))
        .withColumn("remix_group", F.coalesce("remix", old_r))
        .drop("full", "partial", "fuzzy", "remix")
    )
