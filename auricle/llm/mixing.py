"""Mix documents of several sources to target shares of the size in tokens.

Every document gets a hash-random key. The documents are range-sorted by
(source, key) and written; per-partition totals, of which there are as many as
partitions and sources, give the offset of each partition, so prefix sums of
token counts are distributed whatever share of all rows one source holds. A
source's budget is whole epochs of it, within its repeats, and the first
documents of the order for the rest.

Defined results: documents without tokens or without a target source are in no
mix; the document at the cut is in the rest if at least half of it
fits, so the error is at most half a document; a source that
is too small for its budget gives all it may and the report shows the
shortfall; null ``max_repeats`` means once; repeated documents count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auricle.io import materialize
from auricle.llm.tokens import DEFAULT_VOCABULARY, count_tokens

SEED = 20
#: Documents of one range partition, so that tasks stay alike at any size.
ROWS_PER_TASK = 500_000


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running token sum per source of one sorted partition."""
    so_far: dict[str, int] = {}
    for batch in batches:
        ends = batch.groupby("source", sort=False)["n_tokens"].cumsum() + batch["source"].map(lambda s: so_far.get(s, 0))
        for source, end in ends.groupby(batch["source"]).last().items():
            so_far[source] = int(end)
        yield batch.assign(local_end=ends)


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, ends): ``ends`` is the token sum of the source up to and with the document."""
    keyed = counts.withColumn("key", F.xxhash64("doc_id", F.lit(SEED)))
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // ROWS_PER_TASK))
    laid = (
        keyed.repartitionByRange(tasks, "source", "key", "doc_id")
        .sortWithinPartitions("source", "key", "doc_id")
        .withColumn("part", F.spark_partition_id())
        .mapInPandas(_within, "doc_id long, source string, n_tokens long, key long, part int, local_end long")
    )
    laid = materialize(laid)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy("source", "part")
        .agg(F.sum("n_tokens").alias("tokens"))
        .withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .drop("tokens")
    )
    # one row per (source, partition) that holds it; Spark broadcasts it only below its threshold
    return laid.join(offsets, ["source", "part"]).select(
        "doc_id", "source", "n_tokens", (F.col("local_end") + F.col("offset")).alias("ends")
    )


def budgets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (mix_name, source): the budget in tokens, whole epochs and the rest; as small as ``targets``."""
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    whole = counts.agg(F.sum("n_tokens")).first()[0] or 0
    repeats = F.coalesce("max_repeats", F.lit(1)).cast("long")
    out = (
        targets.join(sizes, "source", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
        .withColumn("budget", F.floor(F.lit(whole) * F.col("size_ratio") * F.col("target_share")).cast("long"))
        .withColumn("usable", F.least("budget", F.col("available") * repeats))
    )
    return out.withColumn(
        "epochs", F.when(F.col("available") > 0, F.floor(F.col("usable") / F.col("available"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("usable") - F.col("epochs") * F.col("available"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix, one row per mix and used document with its copies, and the plan of budgets."""
    counts = materialize(count_tokens(documents, vocabulary).where((F.col("n_tokens") > 0) & F.col("source").isNotNull()))
    plan = materialize(budgets(counts, targets))
    chosen = (
        # the stored plan has one row per mix and source; Spark broadcasts it only below its threshold
        prefix_sums(counts)
        .join(plan.select("mix_name", "source", "epochs", "rest"), "source")
        .withColumn("copies", F.col("epochs") + F.when(F.col("ends") * 2 - F.col("n_tokens") <= F.col("rest") * 2, 1).otherwise(0))
        .where(F.col("copies") > 0)
        .select("mix_name", "source", "doc_id", "n_tokens", "copies")
    )
    return chosen, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every source of every mix."""
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    out = plan.join(got, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return out.select(
        "mix_name",
        "source",
        "target_share",
        "budget",
        "tokens",
        F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (F.col("budget") - F.col("tokens")).alias("shortfall"),
    )
