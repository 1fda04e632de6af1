"""One surviving record for each group of copies, with the best known value of every field.

Copies are tracks of one act, title and version whose known lengths lie close
together. The survivor is the technically best copy. Field values are fused:
sources (path roots) have an accuracy, estimated with the values; sources that
share false values are taken to copy from each other, and a copied vote counts
less; the value of highest posterior is chosen.

Every step over a group is an aggregate with partial sums (the survivor is a
maximum of structs, lengths are clustered over distinct values), so one group
may hold any share of the rows.

Defined results: rows without an act or a title belong to no group; where the
written length is unknown, the measured duration stands for it; a track of
unknown length and duration joins its group if the lengths of that title form one cluster;
unknown integrity, bitrate and size count as 0; remaining ties go to the
smallest id; null and empty field values are no votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.io import materialize
from auricle.llm.encoding import SOURCE
from auricle.operators.malformed import length_in_seconds, size_in_bytes

#: Known lengths of one group differ by at most this many seconds from the next one.
SLACK = 3
FIELDS = ["album", "year", "genre", "track_number", "album_artist", "label", "disc_number", "original_year"]
#: Rounds of the estimation end when no accuracy moves by more than this.
STILL = 0.005
MOST_ROUNDS = 20
#: Prior that two sources depend on each other, and the chance that a dependent source copied a value.
DEPENDENT, COPIED = 0.2, 0.8
#: False values that a field may take.
FALSE_VALUES = 20


def fold(text: Column) -> Column:
    """Letters and digits only, lower case, ``&`` as ``and``."""
    out = F.replace(F.lower(F.replace(text, F.lit("&"), F.lit(" and "))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(out, "ς", "σ"), r"[^\p{L}\p{M}\p{N}]+", "")


def members(tracks: DataFrame, technical: DataFrame) -> DataFrame:
    """Tracks of groups of two or more with their ``group_key`` and ``cluster``."""
    keyed = tracks.select(
        "metadata_id",
        F.concat_ws("|", F.nullif(fold(F.col("artist")), F.lit("")), F.nullif(fold(F.col("title")), F.lit(""))).alias("group_key"),
        length_in_seconds(F.col("length_seconds")).alias("seconds"),
        F.coalesce(size_in_bytes(F.col("file_size")), F.lit(0)).alias("bytes"),
        F.regexp_extract(F.coalesce("full_path", F.lit("")), SOURCE, 1).alias("source"),
        "artist",
        "title",
        *FIELDS,
    ).where("instr(group_key, '|') > 1")
    several = keyed.groupBy("group_key").agg(F.count("*").alias("copies")).where("copies > 1").select("group_key")
    held = materialize(keyed.join(several, "group_key", "left_semi"))
    tech = technical.select("metadata_id", "integrity_ok", "bitrate", F.round(F.col("duration_ms") / 1000).cast("long").alias("measured"))
    held = held.join(tech, "metadata_id", "left").withColumn("seconds", F.coalesce("seconds", "measured")).drop("measured")
    # clusters over the distinct lengths of a title
    known = held.where("seconds is not null").select("group_key", "seconds").distinct()
    by = Window.partitionBy("group_key").orderBy("seconds")
    step = F.when(F.col("seconds") - F.lag("seconds").over(by) > SLACK, 1).otherwise(0)
    lengths = known.withColumn("step", step).withColumn("cluster", F.sum("step").over(by)).drop("step")
    single = lengths.groupBy("group_key").agg(F.max("cluster").alias("last"))
    put = held.join(lengths, ["group_key", "seconds"], "left").join(single, "group_key", "left")
    cluster = F.when(F.col("seconds").isNotNull(), F.col("cluster")).when(F.coalesce("last", F.lit(0)) == 0, F.lit(0))
    put = put.withColumn("cluster", cluster.cast("int")).where("cluster is not null").drop("last")
    return materialize(put)


def survivors(held: DataFrame) -> DataFrame:
    """(group_key, cluster, metadata_id, copies) of every group of two or more."""
    zero = F.lit(0)
    ok = F.when(F.col("integrity_ok") == 1, 1).otherwise(0)
    # the smallest id wins ties: order ids by their inverted characters through min_by of equal ranks
    rank = F.struct(ok.alias("ok"), F.coalesce("bitrate", zero).alias("bitrate"), F.col("bytes"))
    by_rank = held.groupBy("group_key", "cluster", rank.alias("rank")).agg(F.min("metadata_id").alias("metadata_id"), F.count("*").alias("n"))
    return (
        by_rank.groupBy("group_key", "cluster")
        .agg(F.max_by("metadata_id", "rank").alias("metadata_id"), F.sum("n").alias("copies"))
        .where("copies > 1")
    )


def claims(held: DataFrame) -> DataFrame:
    """(group_key, cluster, field, value, source, n): what each source says, copies of one source pre-aggregated."""
    pairs = [F.struct(F.lit(f).alias("field"), F.trim(F.col(f)).alias("value")) for f in FIELDS]
    return (
        held.select("group_key", "cluster", "source", F.explode(F.array(*pairs)).alias("c"))
        .where("c.value is not null and c.value != ''")
        .groupBy("group_key", "cluster", "c.field", "c.value", "source")
        .agg(F.count("*").alias("n"))
    )


def _votes(said: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_key, cluster, field, value, sources, p): posterior of every value.

    ``sources`` is (source, a, dep): accuracy, and the chance of depending on each source with which it shares a false value.
    """
    judged = said.join(sources, "source")
    together = judged.groupBy("group_key", "cluster", "field", "value").agg(
        F.collect_list(F.struct(F.greatest(F.least("a", F.lit(0.99)), F.lit(0.01)).alias("a"), "source", "dep")).alias("who")
    )

    def weight(acc: Column, s: Column) -> Column:
        # the more accurate of two sources votes first; the vote of the other counts by its independence
        before = F.filter("who", lambda o: (o["a"] > s["a"]) | ((o["a"] == s["a"]) & (o["source"] < s["source"])))
        free = F.aggregate(before, F.lit(1.0), lambda x, o: x * (1 - COPIED * F.coalesce(F.try_element_at(s["dep"], o["source"]), F.lit(0.0))))
        return acc + free * F.log(F.lit(float(FALSE_VALUES)) * s["a"] / (1 - s["a"]))

    scored = together.withColumn("score", F.aggregate("who", F.lit(0.0), weight)).select(
        "group_key", "cluster", "field", "value", F.transform("who", lambda w: w["source"]).alias("sources"), "score"
    )
    of = Window.partitionBy("group_key", "cluster", "field")  # distinct values of one field of one group
    e = F.exp(F.col("score") - F.max("score").over(of))
    return scored.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(of)).drop("e", "score")


def fuse(held: DataFrame) -> DataFrame:
    """(group_key, cluster, field, value, p): the value of highest posterior of every field."""
    said = materialize(claims(held))
    none = F.expr("cast(map() as map<string,double>)")
    sources = said.select("source").distinct().select("source", F.lit(0.8).alias("a"), none.alias("dep"))
    for _ in range(MOST_ROUNDS):
        votes = materialize(_votes(said, sources))
        best = votes.groupBy("group_key", "cluster", "field").agg(
            F.max(F.struct("p", "value")).alias("top"), F.count("*").alias("values")
        ).select("group_key", "cluster", "field", F.col("top.value").alias("value"), F.col("top.p").alias("p"), "values")
        accuracy = votes.select(F.explode("sources").alias("source"), "p").groupBy("source").agg(((F.sum("p") + 4) / (F.count("*") + 5)).alias("a"))
        after = materialize(accuracy.join(_dependence(votes, best), "source", "left").select("source", "a", F.coalesce("dep", none).alias("dep")))
        moved = after.join(sources.select("source", F.col("a").alias("was")), "source").agg(F.max(F.abs(F.col("a") - F.col("was")))).first()[0]
        sources = after
        if (moved or 0.0) <= STILL:
            break
    return best


def _dependence(votes: DataFrame, best: DataFrame) -> DataFrame:
    """(source, dep): the chance of depending on each source with which it shares a false value of a contested field.

    Independent sources rarely share a false value and often differ; sources that share none are taken as independent.
    """
    truth = best.where("values > 1").select("group_key", "cluster", "field", F.col("value").alias("truth"))
    judged = votes.join(truth, ["group_key", "cluster", "field"]).select("group_key", "cluster", "field", (F.col("value") == F.col("truth")).alias("right"), "sources")
    # two sources of one value once; each pair and its order is kept, as there are few sources of one value
    pair = judged.select("right", F.explode("sources").alias("x"), "sources").select("right", "x", F.explode("sources").alias("y")).where("x < y")
    shared = pair.groupBy("x", "y").agg(F.count_if(~F.col("right")).alias("false_shared"), F.count_if("right").alias("true_shared")).where("false_shared > 0")
    # fields on which both speak, to tell how often they differ
    fields = judged.groupBy("group_key", "cluster", "field").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    met = fields.select(F.explode("sources").alias("x"), "sources").select("x", F.explode("sources").alias("y")).where("x < y").groupBy("x", "y").agg(F.count("*").alias("met"))
    same = F.col("false_shared") + F.col("true_shared")
    # log odds of dependence: a shared false value speaks for it, a shared true one little and a difference clearly against it
    odds = (
        math.log(DEPENDENT / (1 - DEPENDENT))
        + F.col("false_shared") * math.log((COPIED + (1 - COPIED) * 0.04 / FALSE_VALUES) / (0.2 / FALSE_VALUES))
        - F.col("true_shared") * 0.25
        + (F.col("met") - same) * math.log(1 - COPIED)
    )
    chance = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))
    pairs = shared.join(met, ["x", "y"]).select("x", "y", chance.alias("v"))
    return pairs.union(pairs.select("y", "x", "v")).groupBy(F.col("x").alias("source")).agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("dep"))


def surviving(tracks: DataFrame, technical: DataFrame) -> DataFrame:
    """One row per group: the survivor's id, the copies, act, title, and the fused value of every field."""
    held = members(tracks, technical)
    chosen = survivors(held)
    fused = fuse(held.join(chosen.select("group_key", "cluster"), ["group_key", "cluster"], "left_semi"))
    wide = fused.groupBy("group_key", "cluster").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS], F.round(F.avg("p"), 6).alias("confidence")
    )
    names = held.select("metadata_id", "artist", "title")
    return chosen.join(wide, ["group_key", "cluster"], "left").join(names, "metadata_id").select(
        "metadata_id", "copies", "artist", "title", *FIELDS, "confidence"
    )
