"""Coercions that keep the semantics of a dynamically typed store under ANSI SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(text: Column) -> Column:
    """Leading digits as an integer, 0 where there are none, null where null."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)))


def truthy(value: Column, default) -> Column:
    """``value or default``: null, 0 and '' give the default."""
    empty = value.isNull() | (value.cast("string").isin("", "0", "0.0", "0E0"))
    return F.when(empty, F.lit(default)).otherwise(value)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    """Null or the empty text."""
    return text.isNull() | (text == "")


def json_list(text: Column) -> Column:
    """A JSON list of strings, empty where it cannot be read."""
    return F.coalesce(F.from_json(text, "array<string>"), F.expr("cast(array() as array<string>)"))


def minutes_seconds(ms: Column) -> Column:
    """``3m 34s``."""
    seconds = F.floor(ms / 1000)
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))


def utc_stamp(ts: Column) -> Column:
    """A moment as text; the session's zone should be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def python_json(values: Column) -> Column:
    """A JSON list of texts with a space after each comma; null where a value is null."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.when(~F.exists(quoted, lambda v: v.isNull()), F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def stable_id(*columns: str) -> Column:
    """An id that is the same in every run."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def comma_list(text: str | None) -> list[str]:
    """Parts of a parameter without outer spaces and empty ones."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def key_values(pairs: list[str]) -> dict[str, object]:
    """Parameters from ``key=value``; numbers become numbers, pairs without ``=`` are an error."""
    out: dict[str, object] = {}
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq:
            raise ValueError(f"not key=value: {pair}")
        try:
            out[key.strip()] = float(value)
        except ValueError:
            out[key.strip()] = value.strip()
    return out
