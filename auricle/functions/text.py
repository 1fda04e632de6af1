"""Names, titles and paths: parsing and comparison keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auricle.functions.coerce import strip

# Words that mark a version of a composition (fixed values).
VERSION_WORDS = [
    "remix", "re-mix", "rmx", "mix", "edit", "dub", "rework", "bootleg", "version", "instrumental", "acapella", r"a\s*cappella",
    r"radio\s*edit", r"extended(?:\s*mix)?", r"club(?:\s*mix)?", r"original(?:\s*mix)?", r"vip(?:\s*mix)?", r"vocal(?:\s*mix)?",
]
DASH_WORDS = ["remix", "rmx", "re-mix", "edit", "dub", "rework", "bootleg", "mix"]
BRACKET_VERSION = rf"(?i)\s*\([^)]*\b(?:{'|'.join(VERSION_WORDS)})\b[^)]*\)\s*$"
DASH_VERSION = rf"(?i)\s+-\s+\S.*\b(?:{'|'.join(DASH_WORDS)})\s*$"
#: A track number before a file's name.
NUMBER_PREFIX = r"^(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.\-_])[\s.\-_]*"

# Release notes after a dash or in brackets that do not change the recording (fixed values).
_COMMON = [
    r"remaster(?:ed)?(?:\s+\d{4})?", r"(?:\d{4}\s+)?remaster(?:ed)?", r"original(?:\s+album)?\s+version", r"deluxe(?:\s+edition)?",
    r"single\s+version", r"album\s+version", r"radio\s+edit", "mono", "stereo", "explicit", "clean",
]
AFTER_DASH = [*_COMMON, r"bonus\s+track(?:\s+version)?", "live", "remix", r".+\s+remix", r".+\s+mix", r".+\s+version", r".+\s+edit", r"\d{4}"]
IN_BRACKETS = [
    *_COMMON, r"bonus\s+track", r"from\s+.+", r"feat\.?\s+.+", r"ft\.?\s+.+", r"with\s+.+", r"live.*", r"remix.*", r"7\"\s*single\s*version", r"\d+\s*remaster.*",
]
_DASH = rf"(?i)\s*[-–—]\s*(?:{'|'.join(AFTER_DASH)})\s*$"
_BRACKET = rf"(?i)\s*\((?:{'|'.join(IN_BRACKETS)})\)\s*$"
_GUEST = r"(?i)\s*(?:feat\.?|ft\.?|featuring)\s+.+$"


def stem(name: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^\\/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def filename_parts(name: Column) -> Column:
    """struct(artist, title) read from ``Artist - Title`` forms; a number on the left is a track number."""
    bare = F.regexp_replace(stem(name), NUMBER_PREFIX, "")
    left, right = F.trim(F.split(bare, " - ", 2)[0]), F.trim(F.try_element_at(F.split(bare, " - ", 2), F.lit(2)))
    numbered = left.rlike(r"^\d+$")
    inner = F.instr(right, " - ") > 0
    artist = F.when(right.isNull(), "").when(~numbered, left).when(inner, F.trim(F.split(right, " - ", 2)[0])).otherwise("")
    title = (
        F.when(right.isNull(), F.trim(bare))
        .when(~numbered, right)
        .when(inner, F.trim(F.try_element_at(F.split(right, " - ", 2), F.lit(2))))
        .otherwise(right)
    )
    return F.struct(artist.alias("artist"), F.regexp_replace(title, r"(?i)\s*\(Unknown Artist\)\s*$", "").alias("title"))


def fill_from_filename(value: Column, name: Column, part: str) -> Column:
    """``value``, or the part of the file name where it is blank."""
    parsed = filename_parts(name)[part]
    return F.when((F.trim(F.coalesce(value, F.lit(""))) == "") & (parsed != ""), parsed).otherwise(value)


def base_title(title: Column) -> Column:
    """The composition's name without a version in final brackets, or else after a dash."""
    cut = F.regexp_replace(title, BRACKET_VERSION, "")
    return strip(F.when(cut != title, cut).otherwise(F.regexp_replace(title, DASH_VERSION, "")))


def match_key(text: Column) -> Column:
    """Lower case words without punctuation."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def release_title(text: Column) -> Column:
    """Up to three passes that take off release notes, guests and final dashes."""
    out = strip(F.coalesce(text, F.lit("")))
    for _ in range(3):
        for pattern in (_DASH, _BRACKET, _GUEST):
            out = F.regexp_replace(out, pattern, "")
        out = strip(F.regexp_replace(strip(out), r"[-–—]+$", ""))
    return out


def without_brackets(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\([^)]*\)", ""), r"\s*\[[^\]]*\]", ""))


def lead_artist(text: Column) -> Column:
    """First of several artists."""
    out = strip(F.coalesce(text, F.lit("")))
    for separator in (",", ";", " & ", " x ", " X "):
        out = F.when(F.instr(out, separator) > 0, strip(F.substring_index(out, separator, 1))).otherwise(out)
    return out


_OTHER, _SPACES = re.compile(r"[^a-z0-9\s]"), re.compile(r"\s+")


def ascii_key(text: str | None) -> str:
    """Decomposed, ASCII, lower case, letters and digits, single spaces."""
    flat = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return _SPACES.sub(" ", _OTHER.sub("", flat)).strip()


@F.pandas_udf(T.StringType())
def ascii_key_udf(texts: pd.Series) -> pd.Series:
    """There is no built-in decomposition, so this key needs Arrow batches."""
    return texts.map(ascii_key)


def plain_ascii(text: str | None) -> str:
    """Decomposed, ASCII, lower case, single spaces; punctuation stays."""
    flat = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode()
    return _SPACES.sub(" ", flat).strip().lower()


@F.pandas_udf(T.StringType())
def import_key(texts: pd.Series) -> pd.Series:
    """The key by which imported titles are searched."""
    return texts.map(plain_ascii)


def title_key(text: Column) -> Column:
    return ascii_key_udf(without_brackets(release_title(text)))


def artist_keys(text: Column) -> Column:
    """The key of the lead artist, and the form with or without a leading article."""
    base = ascii_key_udf(lead_artist(text))
    other = F.when(base.startswith("the "), F.substr(base, F.lit(5))).when(base != "", F.concat(F.lit("the "), base))
    return F.array_distinct(F.filter(F.array(base, other), lambda x: x.isNotNull() & (x != "")))


def canonical_path(path: Column) -> Column:
    """Forward slashes, none doubled or at the ends, lower case."""
    out = F.trim(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"/+", "/"), r"^/+|/+$", ""))


def path_candidates(path: Column, root: str, folder: str) -> Column:
    """Ordered ways in which a remote index may write a local path."""
    full = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/+$", ""))
    base = root.replace("\\", "/").rstrip("/").lower()
    under = full.startswith(base + "/") if base else F.lit(False)
    rel = (
        F.when(under, F.substr(full, F.lit(len(base) + 2)))
        .when(full.rlike(r"^[a-z]:/"), None)
        .otherwise(F.regexp_replace(full, r"^/+", ""))
    )
    ways = F.array(canonical_path(F.concat(F.lit(folder + "/"), rel)), canonical_path(rel), canonical_path(full))
    return F.array_distinct(F.filter(ways, lambda x: x.isNotNull() & (x != "")))


def playlist_id(text: Column) -> Column:
    """Id from an address, a URI or a bare id; else null."""
    got = F.regexp_extract(text, r"(?:playlist[/:])([A-Za-z0-9]+)", 1)
    return F.when(got != "", got).when(text.rlike(r"^[A-Za-z0-9]{22}$"), text)


#: Words of a version tag in brackets (fixed values).
TAG_WORDS = ["remix", "mix", "edit", "version", "dub", "vip", "bootleg", "rework", "live"]
VERSION_TAG = rf"(?i)[\(\[][^\)\]]*(?:{'|'.join(TAG_WORDS)})[^\)\]]*[\)\]]"


def core_title(text: Column) -> Column:
    """Folded title without bracketed version tags anywhere."""
    out = F.regexp_replace(folded(text), VERSION_TAG, "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -_"))


def folded(text: Column) -> Column:
    """Lower case with single inner spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def safe_name(name: Column) -> Column:
    """A file name for an export: letters, digits, space, ``_`` and ``-``."""
    out = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))
    return F.when(F.coalesce(out, F.lit("")) == "", "playlist").otherwise(out)
