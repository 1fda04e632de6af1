"""Bring text that looks the same to one consistent form.

A pattern in the JVM finds the values that hold any character outside the
stable sets; only those reach Python. There, quick-check properties isolate the
unstable segments: compatibility forms and decomposed sequences (with the
starters around them as boundary context), invisible characters, odd spaces,
and words that mix scripts. Only these are normalized and spliced back into the
unchanged rest.

Defined results: null stays null, empty and ASCII text is unchanged; composed
accents, curly quotes, dashes and words wholly in another script are stable;
joiners inside emoji and in scripts that need them are kept; a mixed word that
no single script explains is left as it is. Very long texts are handled whole.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that normalization leaves as they are, written as Java ranges; a coarse filter before the exact check.
_STABLE = (
    r"\x{20}-\x{7E}\x{09}\x{0A}\x{0D}\x{A1}-\x{A7}\x{A9}\x{AB}\x{AC}\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}"
    r"\x{141}-\x{148}\x{14A}-\x{17E}\x{386}\x{388}-\x{3CE}\x{400}-\x{482}\x{48A}-\x{52F}\x{5D0}-\x{5EA}\x{620}-\x{64A}"
    r"\x{1E00}-\x{1E99}\x{1EA0}-\x{1EF9}"
    r"\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{2030}\x{2039}\x{203A}\x{20A0}-\x{20A7}\x{20A9}-\x{20BF}"
    r"\x{3001}-\x{3020}\x{3041}-\x{3096}\x{309D}\x{309E}\x{30A1}-\x{30FE}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
)
_LATIN, _OTHER = r"A-Za-z\x{C0}-\x{24F}", r"\x{370}-\x{52F}"
UNSTABLE = rf"[^{_STABLE}]|[{_LATIN}][{_OTHER}]|[{_OTHER}][{_LATIN}]|[\x{{370}}-\x{{3FF}}][\x{{400}}-\x{{52F}}]|[\x{{400}}-\x{{52F}}][\x{{370}}-\x{{3FF}}]"

#: Letters of other scripts, and rare letters of the same one, that look like Latin letters (fixed values).
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеёіїјоԛрсѕԝхуһԁӏгкпѵ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαγικνορυχϲϳ" "ɑɡıɩ",
        "ABESIJKMHOPCTYXYGQWaeëiïjoqpcswxyhdlrknv" "ABEZHIKMNOPTYXCayikvopuxcj" "agii",
    )
)
_TO_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxSIJsij", "АВЕКМНОРСТУХаеорсухЅІЈѕіј"))
_TO_GREEK = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"))
_WORD = re.compile(r"[^\W\d_]+")
#: Invisible: soft hyphen, grapheme joiner, zero-width and direction marks, word joiner, byte order mark, fillers, variation selectors.
_HIDDEN = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]+"
)
_SPACE = re.compile("[   -     　]")
#: Scripts and symbols in which joiners carry meaning.
_JOINING = re.compile("[֐-ࣿऀ-෿ༀ-࿿က-႟ក-៿᠀-᢯←-⯿\U0001f000-\U0001faff⃣️]")


def _script(ch: str) -> str:
    point = ord(ch)
    if 0x400 <= point <= 0x52F:
        return "c"
    if 0x370 <= point <= 0x3FF:
        return "g"
    if point < 0x250 or 0x1E00 <= point <= 0x1EFF:
        return "l"
    return "i" if 0x250 <= point <= 0x2AF else "o"


def _unify(text: str) -> str:
    """Words of mixed scripts, each in a script that explains all its letters.

    First choice is the script of the unmixed words around it, then the word's most common one.
    """
    around = {"l": 0, "c": 0, "g": 0}
    words = [(m, [_script(c) for c in m.group()]) for m in _WORD.finditer(text)]
    if all(set(s) <= {"l"} or set(s) <= {"c"} or set(s) <= {"g"} or not set(s) <= set("lcgi") for _, s in words):
        return text
    for _, scripts in words:
        if len(set(scripts)) == 1 and scripts[0] in around:
            around[scripts[0]] += len(scripts)
    ways = {"l": LOOK_ALIKE, "c": _TO_CYRILLIC, "g": _TO_GREEK}
    out, at = [], 0
    for m, scripts in words:
        kinds = set(scripts)
        if not kinds <= set("lcgi") or len(kinds) == 1 and kinds != {"i"}:
            continue
        for want in sorted(ways, key=lambda k: (-around[k], -scripts.count(k), "lcg".index(k))):
            if want in kinds or want == "l":
                table = ways[want]
                got = [c if s == want else table.get(c) or table.get(LOOK_ALIKE.get(c, "")) for c, s in zip(m.group(), scripts)]
                if all(got):
                    out += [text[at : m.start()], *got]
                    at = m.end()
                    break
    return "".join([*out, text[at:]])


def _hidden(match: re.Match) -> str:
    text, i, j = match.string, match.start(), match.end()
    before, after = text[i - 1 : i], text[j : j + 1]
    if (before and _JOINING.match(before)) or (after and _JOINING.match(after)):
        return match.group()
    return ""


def _segments(text: str) -> list[tuple[int, int]]:
    """Unstable segments by the quick check, each grown to the starters that normalization may join."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if ord(c) < 0x300 and ud.is_normalized("NFKC", c) or (not ud.combining(c) and ud.is_normalized("NFKC", c) and ord(c) not in range(0x1161, 0x11C3)):
            i += 1
            continue
        start = i
        while start > 0 and (ud.combining(text[start]) or start == i) and not (start < i and not ud.combining(text[start])):
            start -= 1
        end = i + 1
        while end < n and (ud.combining(text[end]) or not ud.is_normalized("NFKC", text[end])):
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
        i = end
    return out


def canonical(text: str) -> str:
    """The consistent form of one text."""
    if text.isascii():
        return text
    text = _HIDDEN.sub(_hidden, text)
    text = _unify(_SPACE.sub(" ", text))
    if not ud.is_normalized("NFKC", text):
        parts, at = [], 0
        for i, j in _segments(text):
            parts += [text[at:i], ud.normalize("NFKC", text[i:j])]
            at = j
        text = "".join([*parts, text[at:]])
    return _unify(text)


def unstable(value: Column) -> Column:
    """Whether the value may be unstable; ASCII texts are told by their size."""
    return F.coalesce((F.octet_length(value) != F.length(value)) & value.rlike(UNSTABLE), F.lit(False))


@F.pandas_udf(T.StringType())
def _canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values.map(canonical, na_action="ignore")


def canonical_column(value: Column) -> Column:
    """Canonical form as a column; stable values are passed to Python as nulls only."""
    return F.when(unstable(value), _canonical(F.when(unstable(value), value))).otherwise(value)


def melt(tracks: DataFrame, songs: DataFrame | None) -> DataFrame:
    """(src_table, rec_key, field_name, value) of the fields that are compared."""
    pairs = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("title", "artist")]
    out = tracks.select(F.col("metadata_id").alias("rec_key"), F.explode(F.array(*pairs)).alias("c")).select(
        F.lit("tracks").alias("src_table"), "rec_key", "c.field_name", "c.value"
    )
    if songs is not None:
        keys = songs.select(
            F.lit("indexedsong").alias("src_table"),
            F.col("song_id").alias("rec_key"),
            F.lit("title_key").alias("field_name"),
            F.col("title_key").alias("value"),
        )
        out = out.unionByName(keys)
    return out


def canonicalize(fields: DataFrame) -> DataFrame:
    """All fields with their ``canonical`` form."""
    return fields.withColumn("canonical", canonical_column(F.col("value")))


def disguised(fields: DataFrame) -> DataFrame:
    """The fields whose value differs from its canonical form."""
    found = fields.where(unstable(F.col("value"))).withColumn("canonical", _canonical("value"))
    return found.where(F.col("canonical") != F.col("value"))
