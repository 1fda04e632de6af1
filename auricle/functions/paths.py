"""Paths of files and of what lies beside or mirrors them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length from which a Windows path needs its long form.
LONG = 260


def sidecar(path: Column) -> Column:
    """The document beside a file."""
    return F.concat(path, F.lit(".sidecar.json"))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def mirrored(path: Column, root: str) -> Column:
    """The same path below another root; a drive becomes a folder."""
    rest = F.regexp_replace(slashed(path), r"^([A-Za-z]):/*", "$1/")
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(rest, r"^/+", ""))


def long_form(path: Column) -> Column:
    """Windows paths of 260 letters and more with the prefix that lifts the limit."""
    return F.when(path.rlike(r"^[A-Za-z]:\\") & (F.length(path) >= LONG), F.concat(F.lit("\\\\?\\"), path)).otherwise(path)


def safe_target(path: Column, suffix: str) -> Column:
    """The path with another suffix."""
    return F.concat(F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), F.lit(f".{suffix}"))


def parent(path: Column) -> Column:
    return F.regexp_replace(slashed(path), r"/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(slashed(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def common_parent(paths: Column) -> Column:
    """The longest folder that all paths of an array lie in, empty where there is none."""
    cut = F.transform(paths, lambda p: F.split(parent(p), "/"))
    start = F.element_at(cut, 1)
    shared = lambda a, b: F.slice(a, 1, F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int") - 1, F.size(a)))
    fit = lambda a, b: F.when(F.exists(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda v: ~v), shared(a, b)).otherwise(a)
    return F.when(F.size(paths) > 0, F.array_join(F.aggregate(cut, start, fit), "/")).otherwise("")
