"""Match records of two sources that share no key, with a confidence.

Titles, acts and paths of both sources are brought to plain keys inside the
JVM. Every row has several composite sort keys of a title, a version and a part
of the act's name. Rows are neighbours where their keys are equal or their
titles and parts are within one edit. A window of a fixed number of rows would
lose neighbours as soon as a title is common, so the window of the sorted
neighbourhood is measured in edits: it holds the whole run of equal keys and
the runs one edit away, which are looked up among the distinct titles and
parts. Neighbours are compared by weighted similarities of their fields. A song
goes to the track of highest confidence; as songs are the only side that may be
used once, this assignment has the highest total confidence.

Defined results: null and empty titles match by the path alone; a
folder that resembles the artist is another name of the act; where none does or
the artist is missing, each folder may be one, but only a name of the other side
confirms it, or the heads of both files' names; rows without any name of an act match nothing; versions (live, remix, edit) must agree, while
featured guests and remaster notes are ignored; ties go to the smaller track
id; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.io import materialize
from auricle.llm.lookalikes import LOOK_ALIKE
from auricle.llm.names import near, parse, relation, swapped

#: Weights of title, act and path, and the confidence from which a pair counts.
WEIGHTS = (0.55, 0.35, 0.10)
LEAST = 0.80
#: Rows for whose acts one task of Python parses the names, so that tasks stay alike at any size.
ROWS_PER_TASK = 100_000

_GUEST = r"(?i)\s*[\(\[](?:feat\.?|ft\.?|featuring|with)\s[^\)\]]*[\)\]]|\s(?:feat\.|ft\.|featuring)\s[^\(\)\[\]]*"
_NOTE = r"(?i)\s*(?:[\(\[]|\s-\s)\s*(?:(?:\d{4}\s)?remaster(?:ed)?(?:\s\d{4})?(?:\sversion)?|album version|single version|mono|stereo|bonus track|explicit)\s*[\)\]]?"
_VERSION = (
    r"(?i)\s*(?:[\(\[]|\s-\s)\s*([^\(\)\[\]]*?(?:live|edit|mix|version|remix|rework|demo|instrumental|acoustic|dub|sessions?|reprise))\s*[\)\]]?\s*$"
)
_INCH = "(?i)\\s+((?:7|12)[\"_” ]?\\s?(?:mix|version))\\s*$"


def _accents() -> tuple[str, str]:
    """Letters with marks and their base letters, by the rule of canonical decomposition."""
    pairs = [(chr(c), ud.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x370, 0x460)]]
    pairs = [(a, b) for a, b in pairs if a != b]
    # letters without a decomposition are lost where names were reduced to ASCII, so they are dropped on both sides
    return "".join(a for a, _ in pairs) + "łøđıæœ", "".join(b for _, b in pairs)


_FROM, _TO = _accents()
_FIELDS = ["title", "acts", "version", "path_title", "maybe", "path_version"]


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def legible(text: Column) -> Column:
    """Hidden characters, full-width forms and look-alike letters inside Latin words undone; ASCII texts pass by their size."""
    bare = F.translate(F.regexp_replace(text, r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]+", ""), *_WIDE)
    latin = F.translate(bare, "".join(LOOK_ALIKE), "".join(LOOK_ALIKE.values()))
    mixed = bare.rlike(r"[A-Za-z][\x{250}-\x{52F}]|[\x{250}-\x{52F}][A-Za-z]")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.when(mixed, latin).otherwise(bare))


def plain(text: Column) -> Column:
    """Lower case without marks, apostrophes and punctuation; single spaces. ``ß``, written out or lost, is no letter.

    ``text`` should be a stored column: it is read several times. ASCII texts skip the translation of letters.
    """
    low = F.lower(text)
    folded = F.replace(F.regexp_replace(F.translate(F.replace(low, F.lit("ß"), F.lit("")), _FROM + "’‘", _TO), r"\p{M}+", ""), F.lit("ss"), F.lit(""))
    out = F.when(F.octet_length(text) == F.length(text), F.replace(low, F.lit("ss"), F.lit(""))).otherwise(folded)
    return F.trim(F.regexp_replace(F.replace(F.replace(out, F.lit("'"), F.lit("")), F.lit("`"), F.lit("")), r"[^\p{L}\p{N}]+", " "))


def _has(text: Column, *parts: str) -> Column:
    """A cheap test before a pattern."""
    out = F.lit(False)
    for p in parts:
        out = out | (F.instr(text, p) > 0)
    return out


def _title_parts(rows: DataFrame, source: str, base: str, version: str) -> DataFrame:
    """Columns ``base`` and ``version`` of the title in ``source``; patterns run only where a title has their marks.

    Each step is stored as a column, so that no expression is evaluated twice.
    """
    c = F.col(source)
    noted = F.regexp_replace(F.regexp_replace(c, _GUEST, ""), _NOTE, "")
    inch = F.regexp_extract("_s", _INCH, 1)
    found = F.when(F.col("_inch") != "", F.replace(F.col("_inch"), F.lit("_"), F.lit(" "))).otherwise(F.regexp_extract("_s", _VERSION, 1))
    cut = F.regexp_replace(F.regexp_replace("_s", _INCH, ""), _VERSION, "")
    return (
        rows.withColumn("_m", _has(c, "(", "[", " - ", " f", " F", "7", "12"))
        .withColumn("_s", F.when(F.col("_m"), noted).otherwise(c))
        .withColumn("_inch", F.when(F.col("_m"), inch).otherwise(""))
        .withColumn("_v", F.when(F.col("_m"), found).otherwise(""))
        .withColumn("_c", F.when(F.col("_m"), cut).otherwise(F.col("_s")))
        .withColumn(version, F.when(F.col("_v") == "", "").otherwise(plain(F.col("_v"))))
        .withColumn(base, F.regexp_replace(plain(F.col("_c")), r"^\d{1,2} (?=\p{L})", ""))
        .drop("_m", "_s", "_inch", "_v", "_c")
    )


def keys(rows: DataFrame, side: int, key: str, title: str, artist: str, path: str) -> DataFrame:
    """(side, id, title, acts, version, path_title, maybe, path_version) of one source.

    ``acts`` are the artist and the folder or head of the file's name that resembles it; where none does, ``maybe`` are the head and all folders.
    """
    parts = F.filter(F.split(F.coalesce(F.col(path), F.lit("")), r"[\\/]"), lambda p: ~p.rlike(r"^([A-Za-z]:|\d{4}|.|)$"))
    file = F.coalesce(F.regexp_replace(F.try_element_at("parts", F.lit(-1)), r"\.\w{2,5}$", ""), F.lit(""))
    slug = (F.instr("file", " ") == 0) & (F.instr("file", "_") > 0)
    spaced = F.when(slug, F.replace("file", F.lit("_"), F.lit(" "))).otherwise(F.col("file"))
    bare = F.regexp_replace("spaced", r"^(?:\[\d+\]|\d{1,2}\s?[-.]|\d{1,2})\s+|^\([^)]*\)-", "")
    none = F.expr("cast(array() as array<string>)")
    named = lambda p: F.replace(F.substring_index(p, " - ", 1), F.lit("_"), F.lit(" "))
    starts = F.transform(F.filter(F.split(F.lower("a"), " "), lambda t: F.length(t) > 3), lambda t: F.concat(F.lit(" "), F.substr(t, F.lit(1), F.lit(3))))
    flat = lambda p: F.concat(F.lit(" "), F.replace(F.lower(p), F.lit("_"), F.lit(" ")))
    resembles = lambda p: F.exists("starts", lambda t: F.instr(flat(p), t) > 0)
    out = (
        rows.select(F.col(key).alias("id"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(artist), F.lit("")).alias("a"), parts.alias("parts"))
        .withColumn("t", legible(F.col("t")))
        .withColumn("a", legible(F.col("a")))
        .withColumn("act", plain(F.col("a")))
        .withColumn("file", file)
        .withColumn("folders", F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))))
        .withColumn("spaced", spaced)
        .withColumn("bare", bare)
        .withColumn("dash", F.instr("bare", " - "))
        .withColumn("lead", F.when(F.col("dash") > 1, F.substr("bare", F.lit(1), F.col("dash") - 1)).otherwise(""))
        .withColumn("led", F.when(F.col("lead") == "", "").when(F.col("lead") == F.col("a"), F.col("act")).otherwise(plain(F.col("lead"))))
        .withColumn("starts", starts)
        .withColumn("folder", F.coalesce(F.try_element_at(F.filter("folders", resembles), F.lit(1)), F.when(resembles(F.col("lead")), F.col("lead")), F.lit("")))
        .withColumn("folder_act", F.when(F.col("folder") == "", "").when(F.col("folder") == F.col("a"), F.col("act")).otherwise(plain(named(F.col("folder")))))
        # all folders are read only where they are asked
        .withColumn("every", F.when(F.col("folder") == "", F.transform("folders", lambda p: plain(named(p)))).otherwise(none))
        .withColumn("none", F.col("bare").rlike(r"^track[ _]\d+$"))
    )
    own = (F.col("led") != "") & ((F.col("act") == "") | (F.col("led") == F.col("act")) | (F.col("led") == F.col("folder_act")) | F.array_contains("every", F.col("led")) | (F.size("folders") == 0))
    rest = F.when(F.col("none"), "").when(own, F.substr("bare", F.col("dash") + 3)).otherwise(F.col("bare"))
    filled = lambda *xs: F.array_distinct(F.filter(F.concat(*xs), lambda x: x != ""))
    out = out.withColumn("rest", rest).withColumn("acts", filled(F.array("act", "folder_act"))).withColumn("maybe", filled(F.array(F.when(own, F.col("led")).otherwise("")), F.col("every")))
    out = out.withColumn("maybe", F.when(F.col("folder") == "", F.array_except("maybe", "acts")).otherwise(none))
    # most files are called as their title
    out = _title_parts(out, "t", "title", "version").withColumn("same", F.col("rest") == F.col("t"))
    out = _title_parts(out.withColumn("rest", F.when(F.col("same"), "").otherwise(F.col("rest"))), "rest", "path_title", "path_version")
    for name in ("title", "version"):
        out = out.withColumn(f"path_{name}", F.when(F.col("same"), F.col(name)).otherwise(F.col(f"path_{name}")))
    return out.select(F.lit(side).alias("side"), "id", *_FIELDS)


# --- comparison -----------------------------------------------------------------------


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _close(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.9 if near(a, b) and _digits(a) == _digits(b) and min(len(a), len(b)) > 3 else 0.0


def _act(mine: set[str], theirs: set[str]) -> float:
    if mine & theirs:
        return 1.0
    if any(near(a, b) for a in mine for b in theirs if min(len(a), len(b)) > 4):
        return 0.95
    return 0.9 if any(relation(_named(a), _named(b)) for a in mine for b in theirs) else 0.0


@lru_cache(20_000)
def _named(name: str) -> dict:
    tokens, kind, _, joined = parse(name)
    return {"name": name, "tokens": tokens, "kind": kind, "joined": joined, "formal": []}


def compare(x: tuple, y: tuple) -> float:
    """Confidence that two rows (title, acts, version, path_title, maybe, path_version) are the same recording.

    0 where versions, titles or acts disagree.
    """
    xt, xa, xv, xp, xm, xpv = x
    yt, ya, yv, yp, ym, ypv = y
    path = WEIGHTS[2] * (1.0 if xp and xp == yp else 0.5)
    if xv == yv and xt and xt == yt and len(xa) and len(ya) and xa[0] == ya[0]:
        return WEIGHTS[0] + WEIGHTS[1] + path
    versions = [{v, *([pv] if pv else [])} if t else {pv} for t, v, pv in ((xt, xv, xpv), (yt, yv, ypv))]
    if not versions[0] & versions[1]:
        return 0.0
    title = max(_close(xt, yt), 0.98 * _close(xp, yp), 0.98 * _close(xt, yp), 0.98 * _close(xp, yt))
    if not title:
        return 0.0
    if len(xa) or len(ya):
        act = max(_act({*xa, *xm}, {*ya}), _act({*xa}, {*ya, *ym}))
    else:  # the heads of the files' names must agree
        act = float(len(xm) > 0 and len(ym) > 0 and xm[0] == ym[0])
    return WEIGHTS[0] * title + WEIGHTS[1] * act + path if act else 0.0


# --- neighbours -------------------------------------------------------------------------


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of an act's name, of which two acts that agree always have one within one edit."""
    for batch in batches:
        rows = []
        for side, act in zip(batch["side"], batch["act"]):
            tokens = parse(act)[0]
            longer = {t for t in tokens if len(t) > 3}
            if len(longer) < 2:
                longer |= {t for t in tokens if len(t) > 1}
            rows += [(side, act, core) for core in {act.replace(" ", ""), "".join(tokens), *(longer or {"".join(sorted(tokens))})} if core]
        yield pd.DataFrame(rows, columns=["side", "act", "core"]).astype({"side": "int32"})


def _thirds(size: Column) -> tuple[Column, Column]:
    """Ends of the first and the second third of a text of this size."""
    return (size / 3).cast("int"), (size * 2 / 3).cast("int")


def _pieces(text: Column, size: Column, left: int, moved: int) -> Column:
    """Hash of the two other thirds of a text of ``size`` letters, if ``text`` is one whose third ``left`` has ``moved`` letters more."""
    p, q = _thirds(size)
    one, end = F.lit(1), F.lit(1 << 20)
    first, second = F.substr(text, one, p), F.substr(text, p + 1 + moved * (left == 1), q - p)
    third = F.substr(text, q + 1 + moved * (left < 3), end)
    return F.xxhash64(size, F.lit(left), *{1: (second, third), 2: (first, third), 3: (first, second)}[left])


def _turned(text: Column, at: Column) -> Column:
    """The letter at ``at`` and the next one change places."""
    one = F.lit(1)
    return F.concat(F.substr(text, one, at - 1), F.substr(text, at + 1, one), F.substr(text, at, one), F.substr(text, at + 2))


def _one_edit_away(texts: DataFrame, text: str) -> DataFrame:
    """(hash, near) of different texts (side 1, side 0) within one edit, as hashes.

    One edit leaves two thirds of a text as they are, unless neighbours of two thirds change places; so the texts meet
    under two thirds, by the size of the other one, and the true distance decides.
    """
    side = lambda n, name: texts.where(F.col("side") == n).select(F.col(text).alias(name)).distinct().where(f"{name} != ''")
    a, b = F.col("a"), F.col("b")
    n = F.length(a)
    p, q = _thirds(n)
    ways = [_pieces(a, n - moved, left, moved) for moved in (0, 1, -1) for left in (1, 2, 3)]
    ways += [_pieces(_turned(a, p), n, 3, 0), _pieces(_turned(a, q), n, 1, 0)]
    ours = side(1, "a").select("a", F.explode(F.array_distinct(F.array(*ways))).alias("piece"))
    theirs = side(0, "b").select("b", F.explode(F.array(*[_pieces(b, F.length(b), left, 0) for left in (1, 2, 3)])).alias("piece"))
    met = ours.join(theirs, "piece").where(a != b).withColumn("d", F.levenshtein("a", "b", 2))
    one = met.where((F.col("d") == 1) | (F.col("d") == 2) & (F.length("a") == F.length("b")) & swapped(a, b))
    return one.select(F.xxhash64("a").alias("hash"), F.xxhash64("b").alias("near")).distinct()


def _sort_keys(rows: DataFrame, cores: DataFrame) -> DataFrame:
    """(row, title, version, core) as hashes: each way to combine a title, a version and a part of the act of a row."""
    own = F.array_distinct(F.filter(F.array("version", "path_version"), lambda v: (v != "") | (F.col("version") == "")))
    versions = F.when(F.col("title") == "", F.array("path_version")).when(F.col("path_version") == "", F.array("version")).otherwise(own)
    titles = F.array_distinct(F.filter(F.array("title", "path_title"), lambda x: x != ""))
    hashed = lambda texts: F.transform(texts, lambda x: F.xxhash64(x))
    out = rows.select("row", hashed(_acts()).alias("acts"), hashed(versions).alias("versions"), F.explode(hashed(titles)).alias("title"))
    out = out.select("row", "title", "acts", F.explode("versions").alias("version")).select("row", "title", "version", F.explode("acts").alias("act"))
    return out.join(cores.select(F.xxhash64("act").alias("act"), F.xxhash64("core").alias("core")), "act").select("row", "title", "version", "core")


def _acts() -> Column:
    return F.concat("acts", "maybe")


def _confident(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sides = [list(zip(*[batch[f"{s}_{f}"] for f in _FIELDS])) for s in ("track", "song")]
        got = [round(compare(x, y), 6) for x, y in zip(*sides)]
        out = batch[["metadata_id", "song_id"]].assign(confidence=got)
        yield out[out["confidence"] >= LEAST]


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(metadata_id, song_id, confidence) of all pairs that ``compare`` accepts.

    It accepts only rows with a title of each within one edit, a common version, and acts with parts within one edit;
    these three make the sort keys, so no pair depends on the number of rows between its two. Rows go by number until
    the pairs are known.
    """
    rows = materialize(left.unionByName(right).withColumn("row", F.monotonically_increasing_id()))
    tracks, songs = rows.where("side = 0"), rows.where("side = 1")
    acts = rows.select("side", F.explode(_acts()).alias("act")).distinct()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    cores = materialize(acts.repartition(tasks).mapInPandas(_cores, "side int, act string, core string"))
    near_title = _one_edit_away(rows.select("side", F.explode(F.array("title", "path_title")).alias("title")), "title")
    near_core = materialize(_one_edit_away(cores, "core"))
    mine = _sort_keys(songs, cores.where("side = 1"))
    mine = mine.unionByName(mine.join(near_core, mine["core"] == near_core["hash"]).select("row", "title", "version", F.col("near").alias("core")))
    mine = materialize(mine)
    mine = mine.unionByName(mine.join(near_title, mine["title"] == near_title["hash"]).select("row", F.col("near").alias("title"), "version", "core"))
    run = F.xxhash64("title", "version", "core").alias("run")
    theirs = _sort_keys(tracks, cores.where("side = 0")).select(F.col("row").alias("track"), run)
    met = theirs.join(mine.select(F.col("row").alias("song"), run), "run").select("track", "song").distinct()
    track = tracks.select(F.col("row").alias("track"), F.col("id").alias("metadata_id"), *[F.col(f).alias(f"track_{f}") for f in _FIELDS])
    song = songs.select(F.col("row").alias("song"), F.col("id").alias("song_id"), *[F.col(f).alias(f"song_{f}") for f in _FIELDS])
    found = met.join(track, "track").join(song, "song").mapInPandas(_confident, "metadata_id string, song_id string, confidence double")
    return found


def assign(pairs: DataFrame) -> DataFrame:
    """The best track of each song: every song has at most one, while a track may have several."""
    best = F.struct((-F.col("confidence")).alias("c"), "metadata_id")
    top = pairs.groupBy("song_id").agg(F.min(best).alias("b"))
    return top.select(F.col("b.metadata_id").alias("metadata_id"), "song_id", (-F.col("b.c")).alias("confidence"))


def match(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """(metadata_id, song_id, confidence)."""
    left = keys(tracks, 0, "metadata_id", "title", "artist", "full_path")
    right = keys(songs, 1, "song_id", "title", "artist", "path")
    return assign(candidates(left, right))
