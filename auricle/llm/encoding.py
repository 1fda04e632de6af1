"""Find and repair text that was decoded with the wrong character encoding.

Values that could hold such damage are found by one pattern in the JVM. The
distinct ones get, in Arrow batches, every decoding chain that undoes them
consistently, with the log likelihood of the restored text under a character
bigram model of all undamaged values. Expectation maximization over the
latent chain, with a prior per (source, field), pools weak evidence across
records; each value is then repaired by its posterior.

Defined results: null, empty and ASCII values are never cases; a value with
U+FFFD or C1 controls that no chain explains is a case without a repair
(``repaired`` is null); repeated rows are judged alike; an empty table gives an
empty result; very long values are scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auricle.io import materialize

FIELDS = ("title", "artist", "album")

#: Single-byte encodings through which UTF-8 is misread (fixed values).
BYTE_CODECS = ("cp1252", "latin1", "mac_roman", "cp437", "cp850", "cp1251")
#: (true encoding, encoding it was read with) of chains without UTF-8 (fixed values).
PLAIN_CHAINS = (
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("cp866", "cp1252"),
    ("cp1253", "cp1252"),
    ("cp1250", "cp1252"),
    ("shift_jis", "cp1252"),
    ("euc_jp", "cp1252"),
    ("shift_jis", "latin1"),
    ("euc_jp", "latin1"),
)
CLEAN, LOSSY = "clean", "lossy"
#: Signs that undamaged text rarely holds: C1 controls, replacement, symbols of DOS, Mac and Windows code pages.
_SYMBOLS = r"\x{80}-\x{9F}\x{FFFD}\x{2190}-\x{25FF}ƒˆ˜†‡•‰€™¢£¤¥¦§¨©ª¬®¯°±²³´µ¶¸¹º¼½¾¿¡×÷ΩŒœŸ\x{F8FF}\x{FB01}\x{FB02}◊ı˝˛˚˙˘ˇ"
_TAIL_1251 = r"\x{80}-\x{BF}\x{0402}-\x{040F}\x{0452}-\x{045F}\x{0490}\x{0491}\x{2013}-\x{2122}"
SUSPECT = (
    rf"[{_SYMBOLS}]"
    r"|[\x{A0}-\x{24F}][\x{A0}-\x{24F}\x{2010}-\x{203A}]"
    r"|[\x{370}-\x{3FF}][\x{80}-\x{24F}]|[\x{80}-\x{24F}][\x{370}-\x{3FF}]"
    rf"|[\x{{410}}-\x{{44F}}][{_TAIL_1251}]"
    r"|\p{Ll}[ÃÂÐÑÎÏ]|[а-яё][А-ЯЁ]"
)
#: Values kept out of the character model: of accented letters in a row, natural text holds two at most.
UNTRUSTED = SUSPECT.replace(r"|[\x{A0}-\x{24F}][\x{A0}-\x{24F}\x{2010}-\x{203A}]", r"|[\x{A0}-\x{24F}]{3}")
SOURCE = r"^([A-Za-z]:\\[^\\]*|/[^/]*/[^/]*)"
#: Values that one task of Python explains, so that tasks stay alike at any size.
ROWS_PER_TASK = 20_000
EM_ROUNDS = 6
#: Pseudo-count of a chain in the prior of a (source, field).
ALPHA = 0.5
_FLOOR = 1e-7
#: Options this much less likely than the best are left out; their posterior is below 1e-20.
HOPELESS = 60.0


def suspicious(value: Column) -> Column:
    """Whether the value could be damaged; texts of one byte a character are told apart by their sizes alone."""
    return F.coalesce((F.octet_length(value) != F.length(value)) & value.rlike(SUSPECT), F.lit(False))


def melt(tracks: DataFrame) -> DataFrame:
    """(metadata_id, source, field_name, value); the source is the root of the path."""
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]
    return tracks.select(
        "metadata_id",
        F.coalesce(F.regexp_extract("full_path", SOURCE, 1), F.lit("")).alias("source"),
        F.explode(F.array(*pairs)).alias("c"),
    ).select("metadata_id", "source", "c.field_name", "c.value")


# --- character model ----------------------------------------------------------------


@lru_cache(1)
def _classes() -> np.ndarray:
    """Symbol of every code point: itself below U+0530 and in kana, else its block of 256 code points."""
    points = np.arange(0x110000)
    return np.where((points < 0x530) | ((points >= 0x3040) & (points < 0x3100)), points, 0x4000 + (points >> 8)).astype(np.int64)


def _pairs(text: str) -> np.ndarray:
    codes = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[:-1] * 0x10000 + codes[1:]


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, int] = {}
    for batch in batches:
        if len(batch):
            keys, counts = np.unique(_pairs("\n" + "\n".join(batch["value"]) + "\n"), return_counts=True)
            for k, c in zip(keys.tolist(), counts.tolist()):
                total[k] = total.get(k, 0) + c
    yield pd.DataFrame({"pair": list(total), "n": list(total.values())}, dtype="int64")


def _untrusted(value: Column) -> Column:
    return F.coalesce((F.octet_length(value) != F.length(value)) & value.rlike(UNTRUSTED), F.lit(False))


def train(values: DataFrame) -> dict[int, int]:
    """Bigram counts of all undamaged values; at most (number of symbols)^2 entries, whatever the data's size."""
    clean = values.where(F.col("value").isNotNull() & ~_untrusted(F.col("value"))).select("value")
    counts = clean.mapInPandas(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counts.collect()}


class Model:
    """Smoothed bigram log probabilities."""

    def __init__(self, pairs: dict[int, int]):
        self.pairs = pairs
        self.first: dict[int, int] = {}
        self.second: dict[int, int] = {}
        for k, n in pairs.items():
            self.first[k >> 16] = self.first.get(k >> 16, 0) + n
            self.second[k & 0xFFFF] = self.second.get(k & 0xFFFF, 0) + n
        self.total = sum(pairs.values()) or 1
        self.cache: dict[int, float] = {}

    def _one(self, pair: int) -> float:
        a, b = pair >> 16, pair & 0xFFFF
        base = max(self.second.get(b, 0) / self.total, _FLOOR)
        return math.log((self.pairs.get(pair, 0) + 5 * base) / (self.first.get(a, 0) + 5))

    def score(self, text: str) -> float:
        out = 0.0
        for pair in _pairs(f"\n{text}\n").tolist():
            got = self.cache.get(pair)
            if got is None:
                got = self.cache[pair] = self._one(pair)
            out += got
        return out


# --- decoding chains ----------------------------------------------------------------


@lru_cache(None)
def _encoder(codec: str) -> dict[str, int]:
    """Character to byte above ASCII; bytes that the code page leaves open stand for the C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_UTF8 = re.compile(
    b"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3})+"
)


def undo_utf8(text: str, codec: str) -> str | None:
    """``text`` with every run that is UTF-8 read as ``codec`` restored; None where there is no such run."""
    table = _encoder(codec)
    out: list[str] = []
    changed = False
    i, n = 0, len(text)
    while i < n:
        if text[i] not in table:
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < n and text[j] in table:
            j += 1
        raw = bytes(table[c] for c in text[i:j])
        at = 0
        if codec == "cp1251" and not _UTF8.fullmatch(raw):  # here the runs are letters: all of them must fit
            out.append(text[i:j])
            i = j
            continue
        for m in _UTF8.finditer(raw):
            out.append(text[i + at : i + m.start()])
            out.append(m.group().decode("utf-8", "replace"))
            at, changed = m.end(), True
        out.append(text[i + at : j])
        i = j
    return "".join(out) if changed else None


#: Whole words without ASCII, as text of another alphabet leaves them.
_RUN = re.compile(r"(?<![A-Za-z])[^\x00-\x7f]{2,}(?:[ ]+[^\x00-\x7f]{2,})*(?![A-Za-z])")


def undo_plain(text: str, true: str, read: str) -> str | None:
    """``text`` restored from ``true`` bytes read as ``read``: whole, or else the runs without ASCII."""
    table = _encoder(read)

    def back(part: str) -> str | None:
        try:
            raw = b"".join(bytes([table[c]]) if c in table else c.encode("ascii") for c in part)
            return raw.decode(true)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None

    if any(c in table for c in text):
        whole = back(text)
        if whole is not None:
            return whole if whole != text else None
        if true not in ("shift_jis", "euc_jp"):
            parts = _RUN.sub(lambda m: back(m.group()) or m.group(), text)
            return parts if parts != text else None
        # multi-byte text may stand beside text that the code page lacks
        parts = re.sub(r"\S+", lambda m: back(m.group()) or m.group(), text)
        return parts if parts != text else None
    return None


_BROKEN = re.compile("[\x80-\x9f�]")


def chains(text: str, model: Model) -> list[tuple[str, str | None, float]]:
    """(chain, restored text, log likelihood) of every explanation of ``text``, the clean one first."""
    base = model.score(text)
    out: list[tuple[str, str | None, float]] = [(CLEAN, text, base)]
    seen = {text}
    frontier = [("", text)]
    while frontier:  # every layer that comes off makes the text shorter
        reached = []
        for name, now in frontier:
            for codec in BYTE_CODECS:
                got = undo_utf8(now, codec)
                if got is not None and got not in seen:
                    seen.add(got)
                    reached.append((f"{name}>utf-8:{codec}".lstrip(">"), got))
        out += [(name, got, model.score(got)) for name, got in reached]
        frontier = reached
    for true, read in PLAIN_CHAINS:
        got = undo_plain(text, true, read)
        if got is not None and got not in seen:
            seen.add(got)
            out.append((f"{true}:{read}", got, model.score(got)))
    if _BROKEN.search(text):
        kept = _BROKEN.sub("", text)
        out.append((LOSSY, None, model.score(kept) + (len(text) - len(kept)) * math.log(1e-3)))
        out = out[1:]  # no undamaged text holds such characters
        # a repair that still holds broken characters is no whole repair
        out = [(c, None if t is not None and _BROKEN.search(t) else t, s) for c, t, s in out]
    return out


def _candidates(pairs: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(pairs)
        for batch in batches:
            rows = []
            for source, field, value, n in zip(batch["source"], batch["field_name"], batch["value"], batch["n"]):
                options = chains(value, model)
                best = max(s for _, _, s in options)
                # the prior cannot make up for this much: its floor is log(1e-6)
                rows += [(source, field, value, n, c, t, s - best) for c, t, s in options if c == CLEAN or s > best - HOPELESS]
            yield pd.DataFrame(rows, columns=["source", "field_name", "value", "n", "chain", "repaired", "loglik"])

    return run


# --- expectation maximization ----------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _posterior(first: bool) -> Column:
    """``p`` of every option of a row: softmax of log likelihood and log prior."""
    if first:
        lp = lambda c: F.when(c["chain"] == CLEAN, F.lit(math.log(0.98))).otherwise(F.lit(math.log(0.001)))
    else:
        lp = lambda c: F.coalesce(F.try_element_at("prior", c["chain"]), F.lit(math.log(1e-6)))
    # loglik is relative to the best option of the row, so exp cannot underflow for all of them
    weights = F.transform("options", lambda c: F.exp(c["loglik"] + lp(c)))
    return _let(weights, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda z: F.transform(e, lambda x: x / z)))


def maximize(values: DataFrame, rounds: int) -> DataFrame:
    """EM with one row per distinct value, its chains in an array: each round is one narrow pass and one small aggregate.

    The prior has (sources x fields x chains) rows; it is joined, not collected.
    """
    now = values.withColumn("p", _posterior(True))
    for _ in range(rounds):
        mass = (
            now.select("source", "field_name", "n", F.explode(F.arrays_zip(F.col("options.chain").alias("chain"), "p")).alias("o"))
            .groupBy("source", "field_name", F.col("o.chain").alias("chain"))
            .agg(F.sum(F.col("n") * F.col("o.p")).alias("mass"))
        )
        prior = mass.groupBy("source", "field_name").agg(
            F.map_from_entries(F.collect_list(F.struct("chain", F.log(F.col("mass") + ALPHA)))).alias("prior"),
            F.log(F.sum(F.col("mass") + ALPHA)).alias("whole"),
        )
        prior = materialize(
            prior.select("source", "field_name", F.transform_values("prior", lambda _, v: v - F.col("whole")).alias("prior"))
        )
        now = values.join(prior, ["source", "field_name"], "left").withColumn("p", _posterior(False))
    return now


def explain(tracks: DataFrame) -> DataFrame:
    """(metadata_id, field_name, value, repaired, chain, confidence) of every damaged field."""
    values = melt(tracks)
    rows = materialize(values.where(suspicious(F.col("value"))))
    pairs = train(values)
    tasks = max(tracks.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    distinct = rows.groupBy("source", "field_name", "value").agg(F.count("*").alias("n"))
    schema = "source string, field_name string, value string, n long, chain string, repaired string, loglik double"
    options = (
        distinct.repartition(tasks).mapInPandas(_candidates(pairs), schema)
        .groupBy("source", "field_name", "value", "n")
        .agg(F.collect_list(F.struct("chain", "repaired", "loglik")).alias("options"))
    )
    judged = maximize(materialize(options), EM_ROUNDS)
    best = F.array_max(F.transform(F.arrays_zip("p", "options"), lambda x: F.struct(x["p"], x["options"])))
    decided = (
        judged.withColumn("best", best)
        .select("source", "field_name", "value", F.col("best.p").alias("confidence"), "best.options.chain", "best.options.repaired")
        .where(F.col("chain") != CLEAN)
    )
    return rows.join(decided, ["source", "field_name", "value"]).select(
        "metadata_id", "field_name", "value", "repaired", "chain", "confidence"
    )


def damaged_fields(tracks: DataFrame) -> DataFrame:
    """(metadata_id, field_name) of every damaged field."""
    return explain(tracks).select("metadata_id", "field_name")
