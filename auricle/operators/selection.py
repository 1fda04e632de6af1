"""Order-dependent selections, as rounds of joins instead of loops over rows.

Where groups of one kind lie inside groups of the other, a single aggregate
decides; only rows of groups that overlap go through rounds. Both operators are the lexicographically first independent set of a conflict
graph: a row is decided as soon as it is the first undecided one among its
neighbours, so every round decides all local minima at once and gives the
result of the row-by-row loop. No group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.io import materialize


def first_of_groups(rows: DataFrame, key: str, order: str, groups: list[str]) -> DataFrame:
    """Keep a row unless an earlier kept row shares one of its groups; null and empty groups conflict with nothing.

    ``order`` must be unique; a skipped row does not mark its other groups. Repeated keys must not occur.
    """
    state = rows.select(F.col(key).alias("id"), F.col(order).alias("at"), *[F.nullif(F.col(g), F.lit("")).alias(f"g{i}") for i, g in enumerate(groups)])
    names = [f"g{i}" for i in range(len(groups))]
    grouped = F.coalesce(*names).isNotNull()
    kept = state.where(~grouped).select("id")
    left = state.where(grouped)
    if len(names) == 1:
        return rows.join(kept.unionByName(_heads(left, "g0")).withColumnRenamed("id", key), key, "left_semi")
    if len(names) == 2:
        judged = materialize(_nested(_nested(left, "g0", "g1"), "g1", "g0"))
        for g in names:
            kept = kept.unionByName(_heads(judged.where(F.col("rule") == g), g))
        left = judged.where("rule is null").select("id", "at", *names)
    kept = kept.unionByName(_in_rounds(left, names))
    return rows.join(kept.withColumnRenamed("id", key), key, "left_semi")


def _heads(state: DataFrame, group: str) -> DataFrame:
    """The first row of every group, by a partial aggregate."""
    return state.groupBy(group).agg(F.min_by("id", "at").alias("id")).select("id")


def _nested(state: DataFrame, inner: str, outer: str) -> DataFrame:
    """``rule`` is ``outer`` for rows of groups in which every row's inner group, if it has one, lies inside the group.

    Such a group shares no row with any other group, so its first row alone is kept.
    """
    inside = state.where(F.col(inner).isNotNull()).groupBy(inner).agg(
        F.when((F.count(outer) == F.count("*")) & (F.min(outer) == F.max(outer)), F.min(outer)).alias("within")
    )
    told = state.join(inside, inner, "left").withColumn("closed", F.col(inner).isNull() | F.coalesce(F.col("within") == F.col(outer), F.lit(False)))
    whole = told.where(F.col(outer).isNotNull()).groupBy(outer).agg(F.bool_and("closed").alias("all_closed"))
    old = F.col("rule") if "rule" in state.columns else F.lit(None).cast("string")
    out = told.drop("within", "closed").join(whole, outer, "left")
    return out.withColumn("rule", F.coalesce(old, F.when(F.col("all_closed"), F.lit(outer)))).drop("all_closed")


def _in_rounds(left: DataFrame, names: list[str]) -> DataFrame:
    """Ids of kept rows, a round deciding all rows that come first in each of their groups."""
    left = materialize(left)
    kept = left.select("id").limit(0)
    while left.limit(1).count():
        judged = left
        for g in names:
            first = left.where(F.col(g).isNotNull()).groupBy(g).agg(F.min("at").alias(f"first_{g}"))
            judged = judged.join(first, g, "left")
        leads = materialize(judged.where(" and ".join(f"({g} is null or at = first_{g})" for g in names)).select("id", *names))
        kept = kept.unionByName(leads.select("id"))
        left = left.join(leads.select("id"), "id", "left_anti")
        for g in names:
            taken = leads.where(F.col(g).isNotNull()).select(g).distinct()
            left = left.join(taken, g, "left_anti")
        left = materialize(left.select("id", "at", *names))
    return kept


def star_clusters(edges: DataFrame) -> DataFrame:
    """(seed, member) from edges (a, b) with a before b: seeds in order take all later neighbours that no seed has."""
    edges = materialize(edges.distinct())
    seeds = None
    left = edges
    while left.limit(1).count():
        has_earlier = left.select(F.col("b").alias("a")).distinct()
        lead = materialize(left.select("a").distinct().join(has_earlier, "a", "left_anti"))
        seeds = lead if seeds is None else seeds.unionByName(lead)
        seen = materialize(left.join(lead, "a", "left_semi").select("b").distinct())
        gone = lead.unionByName(seen.select(F.col("b").alias("a"))).distinct()
        left = left.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti")
        left = materialize(left.select("a", "b"))
    if seeds is None:
        return edges.select(F.col("a").alias("seed"), F.col("b").alias("member"))
    taken = edges.join(seeds, "a", "left_semi").join(seeds.select(F.col("a").alias("b")), "b", "left_anti")
    return taken.groupBy("b").agg(F.min("a").alias("seed")).select("seed", F.col("b").alias("member"))
