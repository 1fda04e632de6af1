"""Measures of decoded audio: arrays in, numbers out. Spectra need numpy, so they run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auricle.functions.features import correlation, deviation, mean, rolloff

# Key profiles over the twelve semitones from the tonic, and the note names (fixed values).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]

SPECTRUM = T.StructType([T.StructField(n, T.DoubleType()) for n in ("centroid", "bandwidth", "rolloff", "flatness", "zcr", "rms", "peak")])


def measures(samples: np.ndarray, rate: float) -> tuple[float, ...] | None:
    """Centroid, bandwidth, 85 % roll-off, flatness, zero-crossing rate, root mean square and peak of one signal."""
    if samples is None or len(samples) < 2:
        return None
    x = np.asarray(samples, float)
    power = np.abs(np.fft.rfft(x)) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    mag, total = np.sqrt(power), np.sqrt(power).sum() or 1.0
    centroid = float((freq * mag).sum() / total)
    bandwidth = float(np.sqrt((((freq - centroid) ** 2) * mag).sum() / total))
    reach = np.cumsum(power)
    rolloff = float(freq[np.searchsorted(reach, 0.85 * reach[-1])]) if reach[-1] > 0 else 0.0
    floor = power + 1e-12
    flatness = float(np.exp(np.log(floor).mean()) / floor.mean())
    zcr = float(np.mean((x[1:] >= 0) != (x[:-1] >= 0)))
    return centroid, bandwidth, rolloff, flatness, zcr, float(np.sqrt((x**2).mean())), float(np.abs(x).max())


def spectrum(rate: float):
    """A UDF from an array of samples to ``SPECTRUM``; null where there are fewer than two samples."""

    @F.pandas_udf(SPECTRUM)
    def run(signals: pd.Series) -> pd.DataFrame:
        rows = [measures(s, rate) or (None,) * 7 for s in signals]
        return pd.DataFrame(rows, columns=SPECTRUM.names, dtype="float64")

    return run


def note_at(index: Column) -> Column:
    """The name of a pitch class from 0; null where the index is null or no class.

    ``element_at`` gives the last of literal elements for a null index, so the index is tested first.
    """
    return F.when(index.isNotNull() & index.between(0, 11), F.element_at(F.array(*[F.lit(n) for n in NOTES]), F.coalesce(index + 1, F.lit(1)).cast("int")))


def key_of(chroma: Column) -> Column:
    """struct(key, mode, score): the strongest pitch class as tonic and the profile that correlates better with it."""
    tonic = (F.array_position(chroma, F.array_max(chroma)) - 1).cast("int")
    turned = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.element_at(chroma, ((i + tonic) % 12 + 1).cast("int")))
    profile = lambda p: F.array(*[F.lit(v) for v in p])
    major, minor = correlation(turned, profile(MAJOR)), correlation(turned, profile(MINOR))
    return F.struct(
        note_at(tonic).alias("key"),
        F.when(major >= minor, "major").when(tonic.isNotNull(), "minor").alias("mode"),
        F.greatest(major, minor).alias("score"),
    )


def loudness(rms: Column) -> Column:
    """Energy from 0 to 1: the mean level over that of a full-scale sine."""
    return F.least(F.lit(1.0), rms / 0.707)


def dynamic_range(samples: Column) -> Column:
    """The peak over the mean level, in dB."""
    level = F.transform(samples, F.abs)
    return F.log10(F.array_max(level) / F.greatest(mean(level), F.lit(1e-9))) * 20


def onset_rate(onsets: Column, seconds: Column) -> Column:
    """Onsets a second, 0 for an empty signal."""
    return F.when(seconds > 0, onsets / seconds).otherwise(0.0)


def cutoff_bin(spectrum: Column, share: float = 0.995) -> Column:
    """The first bin up to which nearly all energy lies."""
    return rolloff(spectrum, share)


def cepstrum(samples: np.ndarray, rate: float, bands: int = 26, keep: int = 13) -> np.ndarray:
    """The first coefficients of the cosine transform of the log energies of mel bands of one signal."""
    x = np.asarray(samples, float)
    power = np.abs(np.fft.rfft(x)) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2) / 2595) - 1)
    rise = (freq[None, :] - edges[:-2, None]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)[:, None]
    fall = (edges[2:, None] - freq[None, :]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)[:, None]
    energy = np.log(np.maximum(0.0, np.minimum(rise, fall)) @ power + 1e-10)
    k, n = np.arange(keep)[:, None], np.arange(bands)[None, :]
    return (np.cos(np.pi * k * (2 * n + 1) / (2 * bands)) @ energy) * np.sqrt(2 / bands)


def contrast(samples: np.ndarray, bands: int = 6, share: float = 0.02) -> np.ndarray:
    """Peak less valley of the log spectrum in bands of octaves."""
    power = np.sort(np.abs(np.fft.rfft(np.asarray(samples, float))) ** 2 + 1e-12) if len(samples) < 2 ** bands else np.abs(np.fft.rfft(np.asarray(samples, float))) ** 2 + 1e-12
    cuts = np.unique(np.concatenate([[0], (len(power) / 2.0 ** np.arange(bands - 1, -1, -1)).astype(int)]))
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = np.sort(np.log(power[lo:hi]))
        n = max(1, int(len(part) * share))
        out.append(part[-n:].mean() - part[:n].mean())
    return np.array(out)


def timbre(rate: float):
    """A UDF from samples to ``mfcc`` and ``contrast``; null where there are fewer than two samples."""

    @F.pandas_udf("mfcc array<double>, contrast array<double>")
    def run(signals: pd.Series) -> pd.DataFrame:
        short = signals.map(lambda s: s is None or len(s) < 2)
        rows = [(None, None) if bad else (cepstrum(s, rate).tolist(), contrast(s).tolist()) for s, bad in zip(signals, short)]
        return pd.DataFrame(rows, columns=["mfcc", "contrast"])

    return run


def quality_flags(samples: Column) -> Column:
    """struct(clipping, silence): shares of samples at full scale, and of samples at most 5 % of the peak."""
    n = F.size(samples)
    level = F.transform(samples, F.abs)
    top = F.array_max(level)
    return F.struct(
        (F.size(F.filter(level, lambda x: x >= 0.999)) / n).alias("clipping"), (F.size(F.filter(level, lambda x: x <= top * 0.05)) / n).alias("silence")
    )


def chunks(samples: Column, size: int) -> Column:
    """Whole chunks of ``size`` samples of mean 0 and deviation 1; a signal that is too short has none, one without any deviation is 0."""
    middle, spread = mean(samples), deviation(samples)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(samples)), F.lit(size)), lambda s: s + size - 1 <= F.size(samples))
    return F.transform(starts, lambda s: F.transform(F.slice(samples, s, F.lit(size)), lambda x: F.when(spread > 0, (x - middle) / spread).otherwise(0.0)))


def classify(rows: DataFrame, key: str, features: str, load_model: Callable[[], Callable[[np.ndarray], tuple[str, float]]]) -> DataFrame:
    """(key, label, confidence): a model that each worker loads once; failures and weak labels are ``unknown``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = load_model()
        except Exception:  # noqa: BLE001
            model = None
        for batch in batches:
            out = []
            for k, x in zip(batch[key], batch[features]):
                try:
                    label, confidence = model(np.asarray(x, float)) if model else ("unknown", 0.0)
                except Exception:  # noqa: BLE001
                    label, confidence = "unknown", 0.0
                out.append((k, label if confidence > 0.1 else "unknown", float(confidence)))
            yield pd.DataFrame(out, columns=[key, "label", "confidence"])

    return rows.select(key, features).mapInPandas(run, f"{key} string, label string, confidence double")
