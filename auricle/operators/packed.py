"""Split fields that hold several values into one row per value.

Ordinary characters of a field are masked, which leaves its delimiter
skeleton. Splitting rules are resolved once per distinct skeleton; each rule
lists, for every value, the token positions it spans. The rules are joined back
(broadcast while their number is below a fixed bound, else by a shuffled join)
and values are cut out by position.

Defined results: null, empty and blank fields, ``[]`` and fields of only
delimiters give no row; empty places take no position; repeated values keep
their own positions; an unclosed quote is plain text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that can structure a field (fixed values).
DELIMITERS = ",;/|\t·\n"
MARKS = DELIMITERS + "[]\"'\\"
#: A token is one mark or a run of ordinary characters.
TOKEN = r"[\[\]\"'\\,;/|\t·\n]|[^\[\]\"'\\,;/|\t·\n]+"
ORDINARY = r"[^\[\]\"'\\,;/|\t·\n]+"
#: Up to this many rules are broadcast; each is a few hundred bytes for a usual field.
BROADCAST_RULES = 20_000
#: Longer skeletons are never broadcast.
LONG_SKELETON = 400


def resolve(skeleton: str) -> list[tuple[int, int, str]]:
    """(first token, number of tokens, quoting) of every value of a skeleton, ``a`` standing for ordinary text.

    Quoting is ``''`` (none), ``'"'`` (doubled double quotes), ``'j'`` (JSON escapes) or ``"'"``.
    """
    tokens, n = skeleton, len(skeleton)
    lo, hi = 0, n
    edge = [i for i, c in enumerate(tokens) if c not in " "]
    listed = bool(edge) and tokens[edge[0]] == "[" and tokens[edge[-1]] == "]" and len(edge) > 1
    if listed:
        lo, hi = edge[0] + 1, edge[-1]
    single = listed and any(tokens[i] == "'" for i in range(lo, hi)) and not any(tokens[i] == '"' for i in range(lo, hi))
    quote = "'" if single else '"'
    out: list[tuple[int, int, str]] = []
    start, i = lo, lo
    while i <= hi:
        if i == hi or tokens[i] in DELIMITERS:
            out.append((start, i - start, ""))
            start = i = i + 1
            continue
        if tokens[i] == quote and all(c == " " for c in tokens[start:i]):
            end = _closing(tokens, i, hi, quote, listed)
            if end is not None:
                stop = end + 1
                while stop < hi and tokens[stop] == " ":
                    stop += 1
                kind = ("'" if single else "j") if listed else '"'
                out.append((i + 1, end - i - 1, kind))
                start = i = stop + 1
                continue
        i += 1
    return out


def _closing(tokens: str, at: int, hi: int, quote: str, escapes: bool) -> int | None:
    """Position of the quote that ends the value begun at ``at``: before a delimiter, the end, or blank and one of these."""
    i = at + 1
    while i < hi:
        if escapes and tokens[i] == "\\":
            i += 2
            continue
        if tokens[i] == quote:
            if not escapes and i + 1 < hi and tokens[i + 1] == quote:
                i += 2
                continue
            j = i + 1
            while j < hi and tokens[j] == " ":
                j += 1
            if j >= hi or tokens[j] in DELIMITERS:
                return i
            if quote == '"':
                return None
        i += 1
    return None


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [resolve(s) for s in batch["skeleton"]]
        yield pd.DataFrame(
            {
                "skeleton": batch["skeleton"],
                "spans": [[{"first": a + 1, "many": b, "quoting": q} for a, b, q in spans] for spans in found],
            }
        )


def skeleton(value):
    """Every run of ordinary characters becomes ``a``, or a space where it is blank."""
    blank = F.regexp_replace(value, r"(?<![^\[\]\"'\\,;/|\t·\n])[ \u00a0\r]+(?![^\[\]\"'\\,;/|\t·\n])", " ")
    return F.regexp_replace(blank, r"(?! (?:[\[\]\"'\\,;/|\t·\n]|$))" + ORDINARY, "a")


def unpack(fields: DataFrame, keep_single: bool = True) -> DataFrame:
    """(src_table, rec_key, value) to (src_table, rec_key, pos, item), positions from 1 as written."""
    fields = fields.where(F.trim("value") != "").select("src_table", "rec_key", "value")
    if not keep_single:
        fields = fields.where(F.col("value").rlike(rf"[{DELIMITERS}]"))
    fields = fields.withColumn("skeleton", skeleton(F.col("value")))
    schema = "skeleton string, spans array<struct<first:int,many:int,quoting:string>>"
    rules = fields.select("skeleton").distinct().mapInPandas(_rules, schema)
    few = rules.select((F.length("skeleton") > LONG_SKELETON).alias("long")).limit(BROADCAST_RULES + 1)
    size = few.agg(F.count("*").alias("n"), F.max("long").alias("long")).first()
    if size["n"] <= BROADCAST_RULES and not size["long"]:
        rules = F.broadcast(rules)
    token = F.regexp_extract_all("value", F.lit(f"({TOKEN})"), 1)

    def cut(span):
        text = F.array_join(F.slice(F.col("tokens"), span["first"], span["many"]), "")
        doubled = F.replace(text, F.lit('""'), F.lit('"'))
        escaped = F.get_json_object(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "$.v")
        bare = F.regexp_replace(text, r"\\(.)", "$1")
        return (
            F.when(span["quoting"] == "", F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
            .when(span["quoting"] == '"', F.trim(doubled))
            .when((span["quoting"] == "j") & (F.instr(text, "\\") > 0), F.trim(F.coalesce(escaped, bare)))
            .when(span["quoting"] == "'", F.trim(bare))
            .otherwise(F.trim(text))
        )

    items = F.filter(F.transform("spans", cut), lambda x: x != "")
    out = (
        fields.join(rules, "skeleton")
        .withColumn("tokens", token)
        .select("src_table", "rec_key", items.alias("items"))
        .where(F.size("items") >= (1 if keep_single else 2))
        .select("src_table", "rec_key", F.posexplode("items").alias("at", "item"))
    )
    return out.select("src_table", "rec_key", (F.col("at") + 1).cast("long").alias("pos"), "item")


def packed_fields(ml_features: DataFrame, artist_stats: DataFrame) -> DataFrame:
    """mood_tags and genres as (src_table, rec_key, value)."""
    return ml_features.select(
        F.lit("ml_features").alias("src_table"), F.col("metadata_id").alias("rec_key"), F.col("mood_tags").alias("value")
    ).unionByName(
        artist_stats.select(
            F.lit("artist_stats").alias("src_table"), F.col("id").cast("string").alias("rec_key"), F.col("genres").alias("value")
        )
    )
