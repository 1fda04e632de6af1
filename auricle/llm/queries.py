"""Queries of the training-data operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auricle.io import load, materialize
from auricle.llm import encoding, lookalikes, matching, mixing, names, pii, survivors, tokens
from auricle.operators.malformed import is_malformed_track


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    tracks = load(spark, d, "tracks")
    cases = lookalikes.disguised(lookalikes.melt(tracks, load(spark, d, "indexedsong")))
    damaged = encoding.damaged_fields(tracks).select(
        F.lit("tracks").alias("src_table"), F.col("metadata_id").alias("rec_key"), "field_name"
    )
    return cases.select("src_table", "rec_key", "field_name").join(damaged, ["src_table", "rec_key", "field_name"], "left_anti")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    fields = lookalikes.melt(load(spark, d, "tracks"), load(spark, d, "indexedsong"))
    return lookalikes.canonicalize(fields).select("src_table", "rec_key", "field_name", "canonical")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(load(spark, d, "tracks"), load(spark, d, "indexedsong"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("metadata_id", "song_id")


def sound_fields(tracks: DataFrame) -> DataFrame:
    """(metadata_id, field_name, value) of title and artist without malformed rows and without cases of p2 and p5.

    Only fields that the patterns of p2 or p5 suspect are judged and joined; all others pass in the scan.
    """
    fields = lookalikes.melt(tracks.where(~is_malformed_track()), None).where(F.col("value").isNotNull()).drop("src_table")
    odd = lookalikes.unstable(F.col("value")) | encoding.suspicious(F.col("value"))
    key = ["rec_key", "field_name"]
    cases = lookalikes.disguised(fields).select(*key).union(
        encoding.damaged_fields(tracks).select(F.col("metadata_id").alias("rec_key"), "field_name")
    )
    kept = fields.where(odd).join(cases, key, "left_anti")
    return fields.where(~odd).unionByName(kept.select(*fields.columns)).withColumnRenamed("rec_key", "metadata_id")


def act_names(spark: SparkSession, d: str) -> DataFrame:
    """(name, n): distinct names of acts, as artists and credited in titles."""
    fields = sound_fields(load(spark, d, "tracks"))
    value = F.when(F.col("field_name") == "artist", F.array(F.trim("value"))).otherwise(names.credited(F.col("value")))
    return fields.select(F.explode(value).alias("name")).where("name != ''").groupBy("name").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs_of(names.acts(materialize(act_names(spark, d))))


def p4_acts(spark: SparkSession, d: str) -> DataFrame:
    return names.acts(materialize(act_names(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged_fields(load(spark, d, "tracks"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.explain(load(spark, d, "tracks")).withColumn("confidence", F.round("confidence", 4))


def sound_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that are no case of p1, p2 or p5; only rows that a pattern suspects are judged and joined."""
    rows = tracks.where(~is_malformed_track())
    odd = lookalikes.unstable(F.col("title")) | lookalikes.unstable(F.col("artist"))
    for field in encoding.FIELDS:
        odd = odd | encoding.suspicious(F.col(field))
    disguised = lookalikes.disguised(lookalikes.melt(rows, None)).select(F.col("rec_key").alias("metadata_id"))
    cases = disguised.union(encoding.damaged_fields(tracks).select("metadata_id"))
    return rows.where(~odd).unionByName(rows.where(odd).join(cases, "metadata_id", "left_anti").select(*rows.columns))


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving(sound_tracks(load(spark, d, "tracks")), load(spark, d, "technical_features"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_survivors(spark, d).select("metadata_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents"))


def p8_vocabulary_use(spark: SparkSession, d: str) -> DataFrame:
    return tokens.vocabulary_use(load(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    acts = pii.act_names(documents, load(spark, d, "tracks"))
    return pii.findings(documents, acts).select("doc_id", "kind", "found").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return pii.redact(documents, pii.act_names(documents, load(spark, d, "tracks")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_canonical, p3_found, p3_matches, p4_found, p4_acts, p5_found, p5_repaired, p7_found, p7_survivors, p8_ids, p8_vocabulary_use, p9_mix, p9_shares, p10_found, p10_redacted)
}
#: SQL cannot express these operators on whole tables; tests compare them with brute force and round trips.
ORACLE: dict[str, str] = {}
