"""Derived musical and technical features as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.functions.coerce import truthy

# Wheel position of every key (fixed values).
CAMELOT = {
    ("C", "major"): "8B", ("C", "minor"): "5A", ("C#", "major"): "3B", ("C#", "minor"): "12A", ("D", "major"): "10B", ("D", "minor"): "7A",
    ("D#", "major"): "5B", ("D#", "minor"): "2A", ("E", "major"): "12B", ("E", "minor"): "9A", ("F", "major"): "7B", ("F", "minor"): "4A",
    ("F#", "major"): "2B", ("F#", "minor"): "11A", ("G", "major"): "9B", ("G", "minor"): "6A", ("G#", "major"): "4B", ("G#", "minor"): "1A",
    ("A", "major"): "11B", ("A", "minor"): "8A", ("A#", "major"): "6B", ("A#", "minor"): "3A", ("B", "major"): "1B", ("B", "minor"): "10A",
}

# Messages of a decoder and their labels (fixed values).
CORRUPTION = [
    ("Header missing", "missing_header"),
    ("Illegal Audio-MPEG-Header|Invalid MPEG audio header", "bad_mpeg_header"),
    ("resync", "resync_needed"),
    ("overread", "frame_overread"),
    ("Error while decoding", "decode_error"),
    ("invalid data found", "invalid_data"),
    ("could not find codec", "missing_codec"),
    ("Discarding ID3", "malformed_id3"),
    ("CRC mismatch|crc error", "crc_error"),
    ("Giving up resync", "resync_failed"),
    (r"Skipped \d+ bytes", "skipped_bytes"),
    ("truncat", "truncated"),
    ("invalid frame size|big_values too big", "bad_frame"),
    ("mismatching block_size", "block_size_mismatch"),
]


# What a classifier takes where a feature is absent or 0 (fixed values).
DEFAULTS = {"bpm": 120.0, "energy": 0.5, "dynamic_range": 6.0, "onsets": 2.0, "rms": 0.1, "key": "C", "mode": "major"}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Every feature of ``DEFAULTS``, the default where it is absent, null, 0 or empty."""
    out = rows
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, truthy(F.col(name), value) if name in rows.columns else F.lit(value))
    return out


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first label whose bound lies above ``value``; null where null."""
    out = reduce(lambda acc, s: acc.when(value < s[0], s[1]), steps, F.when(value.isNull(), None))
    return out.otherwise(last)


def labels(rules: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose conditions hold, in order."""
    return F.filter(F.array(*[F.when(cond, label) for cond, label in rules]), lambda x: x.isNotNull())


def decade(year: Column) -> Column:
    """``1990s`` from a text that begins with a year; null where it does not."""
    number = F.substr(year, F.lit(1), F.lit(4)).try_cast("int")
    return F.concat((F.floor(number / 10) * 10).cast("string"), F.lit("s"))


def year_bucket(year: Column) -> Column:
    return F.when(F.length(year) >= 4, F.substr(year, F.lit(1), F.lit(4)))


def bpm_bucket(bpm: Column) -> Column:
    return ladder(bpm, [(100, "slow"), (120, "mid"), (150, "fast")], "very_fast")


def energy_tier(energy: Column) -> Column:
    return ladder(energy, [(0.33, "low"), (0.66, "medium")], "high")


def popularity_tier(listeners: Column) -> Column:
    return F.coalesce(ladder(listeners, [(1_000, "niche"), (100_000, "mainstream")], "viral"), F.lit("unknown"))


def camelot(key: Column, mode: Column) -> Column:
    pairs = [x for (k, m), v in CAMELOT.items() for x in (F.lit(f"{k} {m}"), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(" ", key, mode))


def camelot_compatible(a: Column, b: Column) -> Column:
    """Same key, same number, or neighbours on the wheel with the same letter; bad keys are never compatible."""
    na, nb = (F.regexp_extract(x, r"^(\d+)\w$", 1).try_cast("int") for x in (a, b))
    gap = F.abs(na - nb)
    near = (F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & gap.isin(1, 11)
    return F.coalesce((a == b) | (na == nb) | near, F.lit(False))


def camelot_rank(key: Column) -> tuple[Column, Column]:
    """(number, letter) for sorting; unreadable keys come last."""
    good = F.coalesce(key.rlike(r"^\d+[A-Za-z]$"), F.lit(False))
    return F.when(good, F.regexp_extract(key, r"^(\d+)", 1).try_cast("int")).otherwise(99), F.when(good, F.right(key, F.lit(1))).otherwise("Z")


def octave_related(a: Column, b: Column) -> Column:
    ok = (a > 0) & (b > 0)
    return F.coalesce(F.when(ok, F.abs(F.greatest(a, b) / F.least(a, b) - 2.0) < 0.1), F.lit(False))


def cross_check_bpm(a: Column, conf_a: Column, b: Column, conf_b: Column) -> Column:
    """struct(bpm, confidence, disagreement) from two estimates."""
    octave, close = octave_related(a, b), F.abs(a - b) <= 10
    bpm = (
        F.when(a.isNull(), b).when(b.isNull(), a).when(octave, F.greatest(a, b)).when(close, (a + b) / 2.0).when(conf_a >= conf_b, a).otherwise(b)
    )
    top = F.greatest(conf_a, conf_b)
    confidence = (
        F.when(a.isNull() & b.isNull(), None).when(a.isNull(), conf_b).when(b.isNull(), conf_a).when(octave, top).when(close, F.least(conf_a, conf_b)).otherwise(top * 0.6)
    )
    disagree = a.isNotNull() & b.isNotNull() & ~octave & ~close
    return F.struct(bpm.alias("bpm"), confidence.alias("confidence"), disagree.alias("disagreement"))


def moods(bpm: Column, energy: Column, dynamic_range: Column, centroid: Column) -> Column:
    """At most five mood words in rule order; ``neutral`` where no rule holds."""
    found = labels(
        [
            ((energy > 0.3) & (bpm > 120), "energetic"),
            (energy < 0.15, "calm"),
            (energy < 0.15, "relaxed"),
            (dynamic_range > 10, "dynamic"),
            (dynamic_range < 4, "monotoned"),
            (centroid > 5000, "bright"),
            (centroid < 2000, "dark"),
            (bpm < 80, "melancholic"),
            (bpm > 140, "uplifting"),
            (bpm.between(125, 135), "danceable"),
        ]
    )
    return F.when(F.size(found) == 0, F.array(F.lit("neutral"))).otherwise(F.slice(found, 1, 5))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def danceability(bpm: Column, energy: Column, onsets: Column, flatness: Column) -> Column:
    return _unit(1.0 - F.abs(bpm - 125) / 125) * 0.3 + energy * 0.3 + F.least(F.lit(1.0), onsets / 5.0) * 0.25 + (1.0 - flatness) * 0.15


def acousticness(flatness: Column, centroid: Column, zcr: Column, dynamic_range: Column) -> Column:
    one = F.lit(1.0)
    return (
        F.least(one, flatness * 3) * 0.3 + (1.0 - F.least(one, centroid / 8000)) * 0.3 + (1.0 - F.least(one, zcr * 10)) * 0.2 + F.least(one, dynamic_range / 10) * 0.2
    )


def vocal_type(flatness: Column, zcr: Column) -> Column:
    return F.when(flatness > 0.35, "instrumental").when((zcr > 0.15) & (flatness > 0.2), "spoken").otherwise("vocal")


def vocal_confidence(flatness: Column, zcr: Column) -> Column:
    kind = vocal_type(flatness, zcr)
    return F.when(kind == "instrumental", F.least(F.lit(0.9), flatness * 2)).when(kind == "spoken", F.least(F.lit(0.8), zcr * 5)).otherwise(0.7)


def era(centroid: Column, energy: Column) -> Column:
    return (
        F.when((centroid > 6000) & (energy > 0.7), "2020s")
        .when((centroid > 4500) & (energy > 0.5), "2010s")
        .when(centroid > 3500, "2000s")
        .when(centroid > 2500, "1990s")
        .when((centroid < 2000) & (energy < 0.5), "1980s")
        .otherwise("unknown")
    )


def tempo_category(bpm: Column) -> Column:
    return ladder(bpm, [(80, "slow"), (100, "moderate"), (120, "mid-tempo"), (140, "upbeat"), (170, "fast")], "very-fast")


def energy_category(energy: Column) -> Column:
    return ladder(energy, [(0.2, "very-low"), (0.4, "low"), (0.6, "medium"), (0.8, "high")], "very-high")


def quality(centroid: Column, flatness: Column, zcr: Column, dynamic_range: Column, peak: Column) -> Column:
    """struct(score, issues)."""
    rules = [
        (dynamic_range < 3, "low_dynamic_range", 0.2),
        (dynamic_range > 15, "high_dynamic_range", 0.1),
        (peak > 0.95, "clipping_detected", 0.3),
        ((peak > 0.9) & (peak <= 0.95), "near_clipping", 0.15),
        (flatness > 0.6, "noise_floor_detected", 0.15),
        (zcr > 0.25, "high_noise", 0.1),
        (centroid < 500, "muffled_audio", 0.15),
    ]
    score = F.lit(0.8)
    for cond, _, cost in rules:
        score = score - F.when(cond, cost).otherwise(0.0)
    return F.struct(_unit(score).alias("score"), labels([(c, n) for c, n, _ in rules]).alias("issues"))


def target_bitrate(codec: Column, kbps: Column, cap: int = 160, scaling: bool = True) -> Column:
    """kbit/s for a lossy target: three quarters of a lossy source, in steps of 8 between 64 and the cap (half to even)."""
    top = max(32, cap)
    if not scaling:
        return F.lit(top)
    lossy = F.lower(codec).isin("mp3", "aac", "vorbis", "wmav2", "wmav1", "opus", "alac", "mp4a")
    wanted = F.when(lossy, F.bround(kbps * 0.75, 0)).otherwise(F.lit(float(top)))
    clamped = F.greatest(F.lit(64.0), F.least(F.lit(float(top)), wanted))
    return F.when(F.coalesce(kbps, F.lit(0)) <= 0, top).otherwise((F.bround(clamped / 8.0, 0) * 8).cast("int"))


def integrity_labels(stderr: Column) -> Column:
    """Labels of a decoder's messages; ``unknown_error`` where it says something else, empty where it says nothing."""
    text = F.trim(F.coalesce(stderr, F.lit("")))
    found = labels([(text.rlike(f"(?i){pattern}"), label) for pattern, label in CORRUPTION])
    return F.when(text == "", F.expr("cast(array() as array<string>)")).when(F.size(found) == 0, F.array(F.lit("unknown_error"))).otherwise(found)


def prune_reasons(seconds: Column, integrity: Column, bitrate: Column, lowpass: Column, silence: Column, clipping: Column) -> Column:
    """Reasons to review a file, joined by ``|``."""
    rate = F.coalesce(bitrate, F.lit(0))
    return F.array_join(
        labels(
            [
                (seconds < 48, "very_short_lt48s"),
                ((integrity == 0) & (rate > 0) & (rate < 160_000), "integrity_bad_and_low_bitrate"),
                ((lowpass < 16_000) & (rate > 0) & (rate <= 192_000), "suspected_lowpass_transcode"),
                (silence >= 0.35, "silence_heavy"),
                (clipping >= 0.01, "clipping_detected"),
            ]
        ),
        "|",
    )


# --- arrays ---------------------------------------------------------------------------


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def deviation(xs: Column) -> Column:
    """Population standard deviation."""
    return F.sqrt(F.aggregate(xs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.greatest(F.lit(0.0), a["q"] / F.size(xs) - (a["s"] / F.size(xs)) * (a["s"] / F.size(xs)))))


def zero_crossings(xs: Column) -> Column:
    """Number of adjacent values of opposite sign."""
    return F.aggregate(
        F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.when((a >= 0) != (b >= 0), 1).otherwise(0)),
        F.lit(0),
        lambda a, x: a + x,
    )


def rolloff(xs: Column, share: float) -> Column:
    """First index (from 0) at which the running sum of squares reaches ``share`` of the whole."""
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("at"))
    step = lambda a, x: F.struct(
        (a["s"] + x * x).alias("s"),
        (a["i"] + 1).alias("i"),
        F.when((a["at"] < 0) & (a["s"] + x * x >= F.lit(share) * total), a["i"]).otherwise(a["at"]).alias("at"),
    )
    return F.aggregate(xs, start, step, lambda a: a["at"])


def correlation(xs: Column, ys: Column) -> Column:
    """Pearson correlation of two arrays of one length."""
    mx, my = mean(xs), mean(ys)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    cov = total(F.zip_with(xs, ys, lambda x, y: (x - mx) * (y - my)))
    return cov / F.sqrt(total(F.transform(xs, lambda x: (x - mx) * (x - mx))) * total(F.transform(ys, lambda y: (y - my) * (y - my))))
