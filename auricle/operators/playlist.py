"""Playlist strategies: filters, orders, greedy dedup, energy arcs and harmonic chains.

An order is a list of (column, descending) over numbers or text; the id always
comes last, so every result is a total order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import features
from auricle.functions.coerce import blank, leading_int
from auricle.io import materialize
from auricle.operators.selection import first_of_groups

Order = list[tuple[Column, bool]]
Params = dict[str, object]


def _number(name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def ordering(order: Order) -> list[Column]:
    return [(c.desc() if down else c.asc()) for c, down in order] + [F.col("metadata_id").asc()]


def _order_key(order: Order) -> Column:
    """A struct that sorts as the order does; descending columns must be numbers."""
    parts = [(-c if down else c).alias(f"k{i}") for i, (c, down) in enumerate(order)]
    return F.struct(*parts, F.col("metadata_id").alias("id"))


def without_copies(rows: DataFrame, order: Order) -> DataFrame:
    """The first row of every duplicate or remix group, greedily in order."""
    # the candidates are few beside the library, whose joins would run again for each step
    keyed = materialize(rows.withColumn("order_key", _order_key(order)))
    return first_of_groups(keyed, "metadata_id", "order_key", ["duplicate_group", "remix_group"]).drop("order_key")


def ranked(rows: DataFrame, order: Order, limit: int, dedup: bool = True) -> DataFrame:
    """The first ``limit`` rows with a ``position`` from 1; only these reach the task that numbers them."""
    rows = without_copies(rows, order) if dedup else rows
    top = rows.orderBy(*ordering(order)).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*ordering(order))))


# --- filters -----------------------------------------------------------------------------


def any_like(column: str, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).ilike(f"%{w}%") for w in words], F.lit(False))


def custom_filter(params: Params) -> Column:
    """Conjunction of the given parameters; absent and falsy ones do not filter."""
    cond = F.lit(True)
    get = params.get
    if get("genres"):
        cond = cond & F.col("genre_primary").isin(list(get("genres")))
    if get("include_moods"):
        cond = cond & any_like("mood_tags", list(get("include_moods")))
    for word in get("exclude_moods") or []:
        cond = cond & (F.col("mood_tags").isNull() | ~F.col("mood_tags").ilike(f"%{word}%"))
    for name, column in (("bpm", "bpm"), ("energy", "energy"), ("danceability", "danceability"), ("confidence", "genre_confidence")):
        if get(f"{name}_min"):
            cond = cond & (F.col(column) >= F.lit(get(f"{name}_min")))
        if get(f"{name}_max"):
            cond = cond & (F.col(column) <= F.lit(get(f"{name}_max")))
    if get("year_min") or get("year_max"):
        year = leading_int(F.substr("year", F.lit(1), F.lit(4)))
        cond = cond & ~blank(F.col("year"))
        cond = cond & (year >= get("year_min") if get("year_min") else F.lit(True)) & (year <= get("year_max") if get("year_max") else F.lit(True))
    if get("vocal"):
        cond = cond & (F.col("vocal_type") == F.lit(get("vocal")))
    if get("camelot"):
        cond = cond & (F.col("camelot_key") == F.lit(get("camelot")))
    if get("min_popularity"):
        metric = "play_count" if get("metric") == "play_count" else "listeners"
        cond = cond & (F.coalesce(F.col(metric), F.lit(0)) >= F.lit(get("min_popularity")))
    return cond


def custom_order(sort_by: str | None, seed: int = 0) -> Order:
    """Order of a custom playlist; unknown names mean popularity."""
    orders: dict[str, Order] = {
        "bpm": [(_number("bpm", 9999.0), False)],
        "energy_asc": [(_number("energy"), False)],
        "energy_desc": [(_number("energy"), True)],
        "year": [(F.coalesce(F.col("year"), F.lit("")), False)],
        "danceability": [(_number("danceability"), True)],
        "random": [(F.md5(F.concat(F.col("metadata_id"), F.lit(str(seed)))), False)],
    }
    return orders.get(sort_by or "", [(_number("listeners"), True)])


# --- strategies -----------------------------------------------------------------------------


def genre(library: DataFrame, p: Params) -> DataFrame:
    rows = library.where(F.col("genre_primary") == F.lit(p["genre"]))
    return ranked(rows, [(_number("genre_confidence"), True)], p.get("limit", 50))


def bpm_range(library: DataFrame, p: Params) -> DataFrame:
    rows = library.where(F.col("bpm").between(p.get("bpm_min", 0), p.get("bpm_max", 999)))
    return ranked(rows, [(_number("bpm"), False)], p.get("limit", 50))


def year_range(library: DataFrame, p: Params) -> DataFrame:
    year = F.regexp_extract(F.substr("year", F.lit(1), F.lit(4)), r"^(\d+)", 1).try_cast("int")
    rows = library.where(~blank(F.col("year")) & F.coalesce(year, F.lit(0)).between(p.get("year_min", 1900), p.get("year_max", 2099)))
    order: Order = [(_number("listeners"), True)] if p.get("sort_by") == "popularity" else [(F.col("year"), False)]
    return ranked(rows, order, p.get("limit", 50))


def decade(library: DataFrame, p: Params) -> DataFrame:
    rows = library.where(features.decade(F.col("year")) == F.lit(p["decade"]))
    return ranked(rows, [(F.col("year"), False), (_number("bpm", 9999.0), False)], p.get("limit", 50))


def mood(library: DataFrame, p: Params) -> DataFrame:
    rows = library.where(F.col("mood_tags").ilike(f"%{p['mood']}%"))
    return ranked(rows, [(_number("danceability"), True), (_number("energy"), True)], p.get("limit", 50))


def energy_arc(library: DataFrame, p: Params) -> DataFrame:
    """The lowest energies, rising to the peak and falling after it; equal energies keep their order on both sides."""
    low = ranked(library.where("energy is not null"), [(F.col("energy"), False)], p.get("limit", 50))
    n = F.count("*").over(Window.partitionBy())
    peak = F.greatest(F.lit(0), F.least((n * F.lit(p.get("peak_position", 0.6))).cast("int"), n - 1))
    falls = F.col("position") > peak + 1
    arc = low.withColumn("falls", falls).withColumn("down", F.when(falls, -F.col("energy")).otherwise(F.col("energy")))
    return arc.withColumn("position", F.row_number().over(Window.orderBy("falls", "down", "position"))).drop("falls", "down")


def custom_arc(rows: DataFrame, limit: int, peak_position: float = 0.6) -> DataFrame:
    """Candidates by popularity, then ascending to the peak and strictly reversed after it; unknown energy is 0."""
    return _arc(ranked(rows, custom_order(None), limit).drop("position"), peak_position)


def _arc(top: DataFrame, peak_position: float) -> DataFrame:
    """Few rows of one list with the ``position`` of an arc."""
    e = F.coalesce("energy", F.lit(0.0))
    at = F.row_number().over(Window.orderBy(e, "metadata_id"))
    n = F.count("*").over(Window.partitionBy())
    up = top.withColumn("at", at).withColumn("peak", (n * F.lit(peak_position)).cast("int"))
    place = F.when(F.col("at") <= F.col("peak"), F.col("at")).otherwise(n + F.col("peak") + 1 - F.col("at"))
    return up.withColumn("position", place.cast("int")).drop("at", "peak")


@lru_cache(4096)
def _compatible(a: str | None, b: str | None) -> bool:
    if not a or not b:
        return False
    if a == b:
        return True
    if not (a[:-1].isdigit() and b[:-1].isdigit()):
        return False
    x, y = int(a[:-1]), int(b[:-1])
    return x == y or (a[-1] == b[-1] and abs(x - y) in (1, 11))


def chain(rows: list[tuple[str, str]], seed: str, key: str, limit: int) -> list[str]:
    """Ids from the seed on, always the first unused row (in order) whose key fits the last one."""
    out, used, now = [seed], {seed}, key
    while len(out) < limit:
        hit = next(((i, k) for i, k in rows if i not in used and _compatible(now, k)), None)
        if hit is None:
            break
        out.append(hit[0])
        used.add(hit[0])
        now = hit[1]
    return out


def camelot_chain(library: DataFrame, p: Params) -> DataFrame:
    """Harmonic chain from a seed. Only the first ``limit`` rows of each key can matter, so at most that many per key are gathered."""
    limit, seed = p.get("limit", 50), p["seed_id"]
    first = library.where(F.col("metadata_id") == F.lit(seed)).select("camelot_key").first()
    if first is None or not first[0]:
        raise ValueError("the seed is missing or has no key")
    pool = without_copies(library.where("camelot_key is not null"), [])
    of_key = Window.partitionBy("camelot_key").orderBy("metadata_id")
    heads = pool.withColumn("rank", F.row_number().over(of_key)).where(F.col("rank") <= limit + 1).select("metadata_id", "camelot_key")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("metadata_id")
        ids = chain(list(zip(rows["metadata_id"], rows["camelot_key"])), seed, first[0], limit)
        return pd.DataFrame({"metadata_id": ids, "position": range(1, len(ids) + 1)})

    return heads.groupBy().applyInPandas(walk, "metadata_id string, position int")


def harmonic(rows: list[tuple[str, str | None, float | None]], reorder: bool = False) -> list[str]:
    """All ids from the first row on: the compatible row of smallest tempo gap, else the smallest gap of all.

    With ``reorder`` the rows that are left take the order of their gaps then, which decides later ties.
    """
    left, out = list(rows), []
    if not left:
        return out
    now = left.pop(0)
    out.append(now[0])
    while left:
        gaps = [abs((r[2] or 0.0) - (now[2] or 0.0)) for r in left]
        fits = [i for i, r in enumerate(left) if _compatible(now[1], r[1]) and gaps[i] < 999]
        if reorder and not fits:
            left.sort(key=lambda r: abs((r[2] or 0.0) - (now[2] or 0.0)))
            i = 0
        else:
            i = min(fits or range(len(left)), key=lambda k: gaps[k])
        now = left.pop(i)
        out.append(now[0])
    return out


def harmonic_chain(library: DataFrame, p: Params) -> DataFrame:
    """Custom playlist in harmonic order; the pool is the first three times ``limit`` by popularity, taken in id order."""
    limit = p.get("limit", 50)
    pool = ranked(library.where(custom_filter(p)), custom_order(None), 3 * limit).select("metadata_id", "camelot_key", "bpm")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("metadata_id").astype(object)
        rows = rows.where(rows.notna(), None)
        ids = harmonic(list(zip(rows["metadata_id"], rows["camelot_key"], rows["bpm"])))[:limit]
        return pd.DataFrame({"metadata_id": ids, "position": range(1, len(ids) + 1)})

    return pool.groupBy().applyInPandas(walk, "metadata_id string, position int")


def custom(library: DataFrame, p: Params) -> DataFrame:
    limit, sort_by = p.get("limit", 50), p.get("sort_by")
    if sort_by == "harmonic":
        return harmonic_chain(library, p)
    rows = library.where(custom_filter(p))
    if sort_by == "energy_arc":
        return custom_arc(rows, limit)
    return ranked(rows, custom_order(sort_by, p.get("seed", 0)), limit)


# --- curated lists ------------------------------------------------------------------------

#: Lists of several dimensions: filters, number, order, and whether the best known or a mix of the surest is taken.
SPECS: list[Params] = [
    {"name": "night trance", "genres": ["trance"], "include_moods": ["hazy"], "bpm_min": 100, "bpm_max": 180, "confidence_min": 0.3, "limit": 60, "sort": "harmonic"},
    {"name": "nineties revival", "decades": ["1990s"], "tags": ["trance"], "limit": 50, "sort": "bpm", "popular": True},
    {"name": "minimal session", "genres": ["techno", "electro"], "bpm_min": 110, "bpm_max": 150, "energy_max": 0.8, "limit": 50, "sort": "harmonic"},
    {"name": "sunrise", "genres": ["trance", "deep house"], "include_moods": ["bright"], "limit": 50, "sort": "energy_arc"},
    {"name": "lounge", "genres": ["ambient", "downtempo"], "include_moods": ["calm", "hazy"], "energy_max": 0.6, "acousticness_min": 0.2, "limit": 50, "sort": "bpm"},
    {"name": "peak hour", "include_moods": ["restless", "bright"], "bpm_min": 120, "energy_min": 0.3, "danceability_min": 0.6, "limit": 60, "sort": "energy_arc", "popular": True},
    {"name": "dark repetition", "genres": ["techno", "dub", "breakbeat"], "exclude_moods": ["bright", "calm"], "bpm_min": 90, "bpm_max": 160, "limit": 50, "sort": "bpm"},
    {"name": "classics of the 2000s", "decades": ["2000s"], "limit": 60, "sort": "harmonic", "popular": True},
    {"name": "fast ride", "bpm_min": 160, "bpm_max": 180, "limit": 50, "sort": "bpm"},
    {"name": "bass weight", "genres": ["dub", "breakbeat"], "limit": 50, "sort": "energy_arc"},
    {"name": "jazz hour", "genres": ["jazz", "tin-can jazz"], "acousticness_max": 0.9, "limit": 40, "sort": "bpm"},
    {"name": "folk evening", "genres": ["folk"], "energy_max": 0.9, "limit": 40, "sort": "bpm"},
    {"name": "known everywhere", "min_popularity": 1000, "limit": 50, "sort": "bpm", "popular": True},
    {"name": "easy to dance to", "danceability_min": 0.7, "bpm_min": 115, "bpm_max": 130, "limit": 50, "sort": "energy_arc"},
    {"name": "house through the decades", "genres": ["deep house"], "decades": ["1980s", "1990s", "2000s", "2010s"], "limit": 50, "sort": "bpm"},
]


def curated_pool(library: DataFrame, spec: Params, tags: DataFrame | None = None) -> DataFrame:
    """Rows with tempo, energy and a classification that pass all filters; ``tags`` is (metadata_id, tag)."""
    rows = library.where("bpm is not null and energy is not null and classified").where(custom_filter(spec))
    if spec.get("decades"):
        rows = rows.where(features.decade(F.col("year")).isin(list(spec["decades"])))
    if spec.get("acousticness_min"):
        rows = rows.where(F.col("acousticness") >= spec["acousticness_min"])
    if spec.get("acousticness_max"):
        rows = rows.where(F.col("acousticness") <= spec["acousticness_max"])
    if spec.get("tags") and tags is not None:
        rows = rows.join(tags.where(F.lower("tag").isin([t.lower() for t in spec["tags"]])).select("metadata_id").distinct(), "metadata_id", "left_semi")
    return rows


def curated(library: DataFrame, spec: Params, tags: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """One list: copies left out in id order; the best known, or a mix of the three times ``limit`` surest; then the list's order."""
    n = spec["limit"]
    pool = without_copies(curated_pool(library, spec, tags), [])
    if spec.get("popular"):
        chosen = pool.orderBy(*ordering([(_number("listeners"), True)])).limit(n)
    else:
        surest = pool.orderBy(*ordering([(_number("genre_confidence"), True)])).limit(3 * n)
        chosen = surest.orderBy(F.md5(F.concat("metadata_id", F.lit(str(seed)))), "metadata_id").limit(n)
    chosen = chosen.select("metadata_id", "bpm", "energy", "camelot_key", F.lit(spec["name"]).alias("list_name"))
    if spec["sort"] == "harmonic":
        return chosen.groupBy("list_name").applyInPandas(_harmonic_list, "metadata_id string, list_name string, position int")
    if spec["sort"] == "energy_arc":
        return _arc(chosen, 0.6).select("metadata_id", "list_name", "position")
    return chosen.select("metadata_id", "list_name", F.row_number().over(Window.partitionBy("list_name").orderBy("bpm", "metadata_id")).alias("position"))


def _harmonic_list(rows: pd.DataFrame) -> pd.DataFrame:
    """At most ``limit`` rows of one list in harmonic order; without a fitting key the rest is put in the order of tempo gaps."""
    name = rows["list_name"].iloc[0]
    rows = rows.sort_values("metadata_id").astype(object).where(lambda x: x.notna(), None)
    ids = harmonic(list(zip(rows["metadata_id"], rows["camelot_key"], rows["bpm"])), reorder=True)
    return pd.DataFrame({"metadata_id": ids, "list_name": name, "position": range(1, len(ids) + 1)})


STRATEGIES: dict[str, Callable[[DataFrame, Params], DataFrame]] = {
    "genre": genre,
    "bpm_range": bpm_range,
    "year_range": year_range,
    "camelot_chain": camelot_chain,
    "energy_arc": energy_arc,
    "decade": decade,
    "mood": mood,
    "custom": custom,
}


def generate(strategy: str, library: DataFrame, params: Params) -> DataFrame:
    """Rows of a playlist by a named strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return STRATEGIES[strategy](library, params)
