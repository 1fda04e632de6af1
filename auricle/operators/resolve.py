"""Resolve records against an index: ordered keys, tiers, and the best fuzzy match."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.similarity import in_order, letters, parities, places, ratio  # noqa: F401
from auricle.io import materialize
from auricle.operators.dedup import similar_pairs, windows
from auricle.operators.selection import star_clusters

#: Keys of one side that a task compares at once.
BLOCK = 4000


def by_first_key(rows: DataFrame, key: str, candidates: Column, index: DataFrame, index_key: str, value: str) -> DataFrame:
    """The value of the first candidate key that the index holds; candidates are tried in order."""
    tried = rows.select(key, F.posexplode(candidates).alias("at", "_k"))
    hit = tried.join(index.select(F.col(index_key).alias("_k"), value), "_k")
    return hit.groupBy(key).agg(F.min_by(value, F.struct("at", value)).alias(value))


def _near(texts: list[str], left: np.ndarray, right: np.ndarray, group: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of a left and a right text of one group that may reach ``least``: upper bounds by lengths, by characters, by their order."""
    share = least / 100
    size, points, at = letters(texts)
    kinds, letter = np.unique(points, return_inverse=True)
    # the n-th occurrence of a character is an item, so that texts are sets of items
    by = np.argsort(at * len(kinds) + letter, kind="stable")
    run = np.nonzero(np.diff(at[by] * len(kinds) + letter[by], prepend=-1))[0]
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.repeat(run, np.diff(run, append=len(by)))
    first, second = parities(len(texts), at, points | nth.astype(np.uint64) << np.uint64(21), 2).T.copy()
    room = (size * (1 - share) + 5e-7).astype(np.float64)
    width = int(size.max()) + 2
    code = np.unique(group, return_inverse=True)[1].astype(np.int64) * width
    left, right = (x[np.argsort(code[x] + size[x], kind="stable")] for x in (left, right))
    spot = code[right] + size[right]
    lo = np.searchsorted(spot, code[left] + np.ceil(size[left] * share / (2 - share) - 1e-6).astype(np.int64))
    hi = np.searchsorted(spot, code[left] + np.minimum(np.floor(size[left] * (2 - share) / share + 1e-6).astype(np.int64), width - 1), side="right")
    one, two, space = first[right], second[right], room[right]
    # places of each character of the left texts as bits, characters of the right ones in a row
    short = size <= 64
    mask, line = np.zeros((len(texts), 65), np.uint64), np.full((len(texts), int(size[short].max(initial=1))), 64, np.uint8)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    of = short[at]
    np.bitwise_or.at(mask, (at[of], letter[of] % 64), np.uint64(1) << place[of].astype(np.uint64))
    line[at[of], place[of]] = letter[of] % 64

    def ordered(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        free = np.full(len(i), 2**64 - 1, np.uint64)
        for c in range(int(size[j].max(initial=0)) if short[j].all() else line.shape[1]):
            used = free & mask[i, line[j, c]]
            free = (free + used) | (free - used)
        common = np.bitwise_count(~free).astype(np.int64)
        for k in np.nonzero(~(short[i] & short[j]))[0].tolist():
            common[k] = in_order(places(texts[i[k]]), len(texts[i[k]]), texts[j[k]])
        return 200 * common >= least * (size[i] + size[j])

    many = hi - lo > 500
    ahead: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for x in np.nonzero(many)[0].tolist():
        a, u, v = left[x], lo[x], hi[x]
        hit = np.nonzero(np.bitwise_count(one[u:v] ^ first[a]) + np.bitwise_count(two[u:v] ^ second[a]) <= space[u:v] + room[a])[0] + u
        ahead.append((np.full(len(hit), a), right[hit]))
        waiting += len(hit)
        if waiting > 200_000:
            i, j = (np.concatenate(z) for z in zip(*ahead))
            keep = ordered(i, j)
            yield i[keep], j[keep]
            ahead, waiting = [], 0
    if ahead:
        i, j = (np.concatenate(z) for z in zip(*ahead))
        keep = ordered(i, j)
        yield i[keep], j[keep]
    few = np.nonzero(~many)[0]
    for row, k in windows(lo[few], hi[few]):
        i, j = left[few[row]], right[k]
        keep = np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(second[i] ^ second[j]) <= room[i] + room[j]
        i, j = i[keep], j[keep]
        keep = ordered(i, j)
        yield i[keep], j[keep]


def _scores(texts: list[str], i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The exact ratio of each pair; what it prepares of a right text serves all its pairs."""
    by = np.argsort(j, kind="stable")
    match, last = SequenceMatcher(None, "", ""), -1
    for x, y in zip(i[by].tolist(), j[by].tolist()):
        if y != last:
            match.set_seq2(texts[y])
            last = y
        match.set_seq1(texts[x])
        yield x, y, match.ratio() * 100.0


def _alike_in_block(least: float):
    """(mine, theirs, score) of the texts of two blocks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, ours = pdf["text"].tolist(), pdf["mine"].to_numpy(dtype=bool)
        out = []
        for i, j in _near(texts, np.nonzero(ours)[0], np.nonzero(~ours)[0], np.zeros(len(texts), np.int64), least):
            out += [(texts[x], texts[y], score) for x, y, score in _scores(texts, i, j) if score >= least]
        return pd.DataFrame(out, columns=["mine", "theirs", "score"]).astype({"score": "float64"})

    return run


def _alike(mine: DataFrame, theirs: DataFrame, least: float) -> DataFrame:
    """(mine, theirs, score) of distinct texts; all are compared, in pairs of hash-cut blocks.

    A ratio of 70 leaves texts without any common pair of letters possible, so no index is exact; names are few beside rows.
    """
    ours = materialize(mine.distinct().toDF("text"))
    them = materialize(theirs.distinct().toDF("text"))
    height, width = (max(1, -(-x.count() // BLOCK)) for x in (ours, them))
    own = lambda n: F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = ours.select("text", F.lit(True).alias("mine"), own(height).alias("row"), every(width).alias("col")).unionByName(
        them.select("text", F.lit(False).alias("mine"), every(height).alias("row"), own(width).alias("col"))
    )
    return met.groupBy("row", "col").applyInPandas(_alike_in_block(least), "mine string, theirs string, score double")


def _titles_of_artists(least: float):
    """Best song of each (title, artist of songs) of a bucket of artists, or of two blocks of one artist."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        titles, artists, ids = pdf["title_key"].tolist(), pdf["artist"].tolist(), pdf["song_id"].tolist()
        ours = pdf["song_id"].isna().to_numpy()
        best: dict[int, tuple[float, str]] = {}
        for i, j in _near(titles, np.nonzero(ours)[0], np.nonzero(~ours)[0], pd.factorize(pdf["artist"])[0], least):
            for x, y, score in _scores(titles, i, j):
                if score >= least and (x not in best or (-score, ids[y]) < best[x]):
                    best[x] = (-score, ids[y])
        out = [(titles[x], artists[x], -score, song) for x, (score, song) in best.items()]
        return pd.DataFrame(out, columns=["title_key", "artist", "title_score", "song_id"]).astype({"title_score": "float64"})

    return run


def _over_all(rows: DataFrame, songs: DataFrame, alike: DataFrame, least: float) -> DataFrame:
    """(id, song_id, score) of rows compared with all songs: the titles of artists that are alike.

    Titles of an artist with many songs are cut by hash into blocks that meet pairwise.
    """
    theirs = materialize(songs.where("song_artist != ''").groupBy("title_key", F.col("song_artist").alias("artist")).agg(F.min("song_id").alias("song_id")))
    wanted = rows.select("id", "title_key", "artists", F.to_json("artists").alias("who"))
    variants = wanted.select("who", F.explode("artists").alias("variant")).distinct()
    named = materialize(variants.join(alike, "variant").groupBy("who", "artist").agg(F.max("artist_score").alias("artist_score")))
    titles = materialize(wanted.select("who", "title_key").distinct())
    asked = titles.join(named.select("who", "artist"), "who")
    # titles of an artist are counted by whose they are, not by the rows of the join
    height = titles.groupBy("who").agg(F.count("*").alias("n")).join(named, "who").groupBy("artist").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("height"))
    blocks = materialize(height.join(theirs.groupBy("artist").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("width")), "artist"))
    buckets = max(4 * rows.sparkSession.sparkContext.defaultParallelism, theirs.count() // BLOCK)
    own = lambda n: F.pmod(F.xxhash64("title_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # artists of one block share buckets, larger ones have their own groups
    group = F.when((F.col("height") > 1) | (F.col("width") > 1), F.xxhash64("artist")).otherwise(F.pmod(F.xxhash64("artist"), F.lit(buckets))).alias("bucket")
    left = asked.join(blocks, "artist").select(group, "title_key", "artist", F.lit(None).cast("string").alias("song_id"), own("height").alias("row"), every("width").alias("col"))
    right = theirs.join(blocks, "artist").select(group, "title_key", "artist", "song_id", every("height").alias("row"), own("width").alias("col"))
    found = left.unionByName(right).groupBy("bucket", "row", "col").applyInPandas(_titles_of_artists(least), "title_key string, artist string, title_score double, song_id string")
    scored = wanted.drop("artists").join(found.distinct(), "title_key").join(named, ["who", "artist"]).withColumn("score", F.col("title_score") * 0.6 + F.col("artist_score") * 0.4)
    return _first_best(scored)


def _first_best(scored: DataFrame) -> DataFrame:
    """The smallest song of the highest score of each row."""
    top = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("score"), "song_id")).alias("b"))
    return top.select("id", F.col("b.song_id").alias("song_id"), (-F.col("b.score")).alias("score"))


def best_fuzzy(rows: DataFrame, songs: DataFrame, least: float = 70.0) -> DataFrame:
    """(id, song_id, score): 0.6 title + 0.4 artist, both at least ``least``, among the songs of the title key, or all songs if none has it.

    ``rows`` has id, title_key and artist_key, or artist_keys of which the best counts; ``songs`` song_id, title_key, artist_key.
    Ties go to the smallest song id.
    """
    s = songs.select(F.col("song_id").cast("string").alias("song_id"), "title_key", F.col("artist_key").alias("song_artist")).where("title_key != ''")
    keys = F.col("artist_keys") if "artist_keys" in rows.columns else F.array("artist_key")
    keys = F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))
    wanted = materialize(rows.where("title_key != ''").select("id", "title_key", keys.alias("artists")).where("size(artists) > 0"))
    # all artists are compared once, whatever number of rows and songs share a title
    alike = materialize(_alike(wanted.select(F.explode("artists")), s.where("song_artist != ''").select("song_artist"), least).toDF("variant", "artist", "artist_score"))
    songs_of = s.where("song_artist != ''").groupBy("title_key", F.col("song_artist").alias("artist")).agg(F.min("song_id").alias("song_id"))
    met = wanted.select("id", "title_key", F.explode("artists").alias("variant")).join(songs_of, "title_key").join(alike, ["variant", "artist"])
    in_block = _first_best(met.withColumn("score", F.lit(60.0) + F.col("artist_score") * 0.4))
    alone = wanted.join(s.select("title_key").distinct(), "title_key", "left_anti")
    return in_block.unionByName(_over_all(alone, s, alike, least))


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` letters."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def contained(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """(probe, text) of all texts that hold a probe. Both have one column of distinct, not empty texts.

    A text that holds a probe holds its rarest run of three letters, so they meet there; shorter probes meet whole.
    """
    p, t = probes.toDF("probe"), texts.toDF("text")
    held = materialize(t.select("text", F.explode(_grams(F.col("text"), 3)).alias("gram")))
    common = held.groupBy("gram").agg(F.count("*").alias("n"))
    asked = p.where(F.length("probe") > 2).select("probe", F.explode(_grams(F.col("probe"), 3)).alias("gram")).join(common, "gram", "left")
    rarest = asked.groupBy("probe").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("probe", F.col("g.gram").alias("gram"))
    long = rarest.join(held, "gram").where(F.instr(F.col("text"), F.col("probe")) > 0).select("probe", "text")
    short = p.where(F.length("probe") < 3)
    pieces = t.select("text", F.explode(F.array_union(_grams(F.col("text"), 1), _grams(F.col("text"), 2))).alias("probe"))
    return long.unionByName(short.join(pieces, "probe").select("probe", "text"))


def tiered(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, metadata_id, confidence): one track per row by tiers, without case.

    Exact title and artist; else a title and an artist that hold the searched ones; else a title that holds the searched
    one. Within a tier equal titles come first, then equal artists, then the smallest id. Wildcards in a title are letters.
    """
    t = tracks.select("metadata_id", F.lower("title").alias("tk"), F.coalesce(F.lower("artist"), F.lit("")).alias("ak")).where("tk != ''")
    t = materialize(t.groupBy("tk", "ak").agg(F.min("metadata_id").alias("metadata_id")))
    r = rows.select("id", F.lower("title").alias("probe"), F.coalesce(F.lower("artist"), F.lit("")).alias("want")).where("probe != ''")
    pairs = contained(r.select("probe").distinct(), t.select("tk").distinct()).withColumnRenamed("text", "tk")
    asked = r.select("probe", "want").distinct()
    met = asked.join(pairs, "probe").join(t, "tk")
    same_title, same_artist = F.col("tk") == F.col("probe"), F.col("ak") == F.col("want")
    named = (F.col("want") != "") & (F.instr(F.col("ak"), F.col("want")) > 0)
    tier = F.when(named & same_title & same_artist, 0).when(named, 1).otherwise(2)
    place = F.struct(tier.alias("tier"), F.when(same_title, 0).otherwise(1).alias("t"), F.when(named & same_artist, 0).otherwise(1).alias("a"), "metadata_id")
    best = met.groupBy("probe", "want").agg(F.min(place).alias("b"))
    out = r.join(best, ["probe", "want"])
    return out.select("id", F.col("b.metadata_id").alias("metadata_id"), F.when(F.col("b.tier") == 0, "exact").otherwise("fuzzy").alias("confidence"))


def match_rank(candidates: DataFrame, key: str, score: str, tie: str, least: float) -> DataFrame:
    """The best candidate of each key at or above ``least``."""
    return candidates.where(F.col(score) >= least).groupBy(key).agg(
        F.max_by(F.struct(*candidates.columns), F.struct(F.col(score), F.col(tie))).alias("b")
    ).select("b.*")


def audit(members: DataFrame, by: str, item: str) -> DataFrame:
    """Members, distinct members and repeats of each list."""
    return members.groupBy(by).agg(
        F.count("*").alias("members"), F.countDistinct(item).alias("distinct_members"), (F.count("*") - F.countDistinct(item)).alias("repeats")
    )


def fuzzy_repeats(members: DataFrame, by: str, order: str, least: float = 85.0) -> DataFrame:
    """(by, fuzzy_repeats): members whose artist key an earlier kept member has, with an equal or similar title key.

    Needs ``artist_key`` and ``title_key``. Members are taken in order; a repeat is not kept, so later ones are compared
    with kept ones only: these are star clusters of the links between members of one list and artist. ``order`` must sort as text.
    """
    m = members.select(by, F.col(order).alias("at"), "artist_key", "title_key")
    seen = m.groupBy(by, "artist_key", "title_key").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    # one group is a list and an artist; groups are cut into blocks that meet pairwise, so none is compared in one task
    mark = F.lit("\x1f")
    rows = seen.select(
        F.concat(F.col("at").cast("string"), mark, F.col(by).cast("string")).alias("metadata_id"), F.concat(F.col(by).cast("string"), mark, "artist_key").alias("artist"), F.col("title_key").alias("title"), F.lit(None).cast("long").alias("duration_ms")
    )
    stars = star_clusters(similar_pairs(rows, least / 100))
    lists = seen.select(by, F.concat(F.col("at").cast("string"), mark, F.col(by).cast("string")).alias("member"))
    similar = lists.join(stars.select("member"), "member").groupBy(by).agg(F.count("*").alias("similar"))
    # copies of a kept or repeated title repeat it, except its first occurrence
    same = seen.groupBy(by).agg(F.sum(F.col("n") - 1).alias("same"))
    return same.join(similar, by, "left").select(by, (F.col("same") + F.coalesce("similar", F.lit(0))).cast("long").alias("fuzzy_repeats"))
