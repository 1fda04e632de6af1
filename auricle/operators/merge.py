"""Merges by rewrite: the result is the new state of the table, keyed and without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions.coerce import blank


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in order; absent ones become null."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows stay; new keys are added, first wins inside the batch."""
    fresh = first_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(align(fresh, old))


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones whole: columns that the new rows lack become null."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(align(new, old))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], keep_old_on_null: bool = True) -> DataFrame:
    """Listed columns are updated and the rest kept; unknown keys are inserted."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        fresh = F.col(f"_new_{c}")
        return (F.coalesce(fresh, F.col(c)) if keep_old_on_null else F.when(F.col("_hit"), fresh).otherwise(F.col(c))).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def fill_if_empty(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values only where the old one is null or empty."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(n, keys, "left")
    fill = lambda c: F.when(blank(F.col(c)), F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[fill(c) if c in columns else F.col(c) for c in old.columns])


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


# --- ordered members ----------------------------------------------------------------------


def compact(members: DataFrame, by: str, position: str, order: list[Column]) -> DataFrame:
    """Positions 1..n inside each list."""
    return members.withColumn(position, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def move_to(members: DataFrame, by: str, position: str, source: int, target: int) -> DataFrame:
    """The member at ``source`` goes to ``target`` (clamped to the list); those between shift by one."""
    n = F.max(position).over(Window.partitionBy(by))
    to = F.greatest(F.lit(1), F.least(F.lit(target), n))
    p = F.col(position)
    moved = (
        F.when(n < source, p)
        .when(p == source, to)
        .when((F.lit(source) < to) & (p > source) & (p <= to), p - 1)
        .when((F.lit(source) > to) & (p >= to) & (p < source), p + 1)
        .otherwise(p)
    )
    return members.withColumn(position, moved.cast("int"))


def swap_up(members: DataFrame, by: str, position: str, at: int) -> DataFrame:
    """The member at ``at`` changes places with the one before it."""
    p = F.col(position)
    n = F.max(position).over(Window.partitionBy(by))
    ok = (n >= at) & F.lit(at > 1)
    return members.withColumn(position, F.when(ok & (p == at), p - 1).when(ok & (p == at - 1), p + 1).otherwise(p).cast("int"))


# --- jobs -------------------------------------------------------------------------------------


def latest_state(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Fold an append-only event log into the last event of each key; a partial aggregate, safe for hot keys."""
    rest = [c for c in events.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in [seq] + [r for r in rest if r != seq]]))
    return events.groupBy(*keys).agg(top.alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def retry_failed(jobs: DataFrame, stage: str | None, max_attempts: int) -> DataFrame:
    """Failed jobs of a stage return to pending while attempts are left (0: always)."""
    hit = F.col("status") == "failed"
    if stage:
        hit = hit & (F.col("stage") == stage)
    if max_attempts:
        hit = hit & (F.col("attempts") < max_attempts)
    return jobs.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def expire_leases(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Running jobs claimed too long ago return to pending."""
    late = (F.col("status") == "running") & (F.col("claimed_at") < now - F.make_interval(secs=F.lit(seconds)))
    return jobs.withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def coalesce_into(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values only where the old one is null; unlike ``fill_if_empty`` an empty text counts as a value."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(n, keys, "left")
    return joined.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in columns else F.col(c) for c in old.columns])
