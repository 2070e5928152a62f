"""Planning of a batch of model calls, and its progress and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.functions.lookups import DEFAULT_COST
from wherescore.operators.joins import spread_join
from wherescore.operators.prefix import running_sums
from wherescore.sources.scratch import settle


def first_rows(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` rows by a unique row position of any type that can be sorted.

    Positions are written in ranges, one after the other over the tasks; the counts of the ranges tell in which of them the
    n-th position lies, so no task sorts more than its range. Rows without a position are left out.
    """
    if n <= 0:
        return df.limit(0)
    placed = df.where(F.col(order).isNotNull())
    ranges = settle(
        placed.select(F.col(order).alias("_at"))
        .repartitionByRange("_at")
        .sortWithinPartitions("_at")
        .select("_at", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    )
    counts = ranges.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()
    left = n
    for part in counts:
        if left <= part["n"]:
            last = ranges.where((F.col("_part") == part["_part"]) & (F.col("_row") == part["first"] + left - 1)).select("_at")
            return placed.where(F.col(order) <= last.scalar())
        left -= part["n"]
    return placed


def pending_work(
    annotations: DataFrame, done: DataFrame | None, pilot: int | None = None, order: str = "ord"
) -> DataFrame:
    """Rows still to process: the pilot rows, or all, without the ids that are done.

    The pilot is cut before finished ids are skipped, and a repeated id stays repeated.
    """
    work = annotations if pilot is None else first_rows(annotations, pilot, order)
    if done is None:
        return work
    ids = done.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id")).distinct()
    return spread_join(work, ids, ["id"], "left_anti")


def run_summary(results: DataFrame) -> DataFrame:
    """Correct and processed rows and the percentage; NULL if nothing was processed."""
    hits = F.sum(F.coalesce(F.col("correct").cast("int"), F.lit(0)))
    return results.agg(
        F.coalesce(hits, F.lit(0)).alias("correct"),
        F.count("*").alias("processed"),
        F.try_divide(hits * 100.0, F.count("*")).alias("percent_correct"),
    )


def cost_estimate(annotations: DataFrame, models: DataFrame, pilot: int | None = None) -> DataFrame:
    """Rough cost of a run for every model: items times the price per item, 0.02 where none is known."""
    price = F.coalesce(F.col("cost_per_item"), F.lit(DEFAULT_COST))
    count = F.lit(pilot).cast("bigint") if pilot is not None else annotations.agg(F.count("*")).scalar()
    items = models.select("model_key", price.alias("cost_per_item"), count.alias("n_items"))
    return items.withColumn("estimated_cost", F.col("cost_per_item") * F.col("n_items"))


def running_accuracy(
    results: DataFrame, by: Sequence[str] = ("model",), order: str = "ord", partitions: int | None = None
) -> DataFrame:
    """Processed and correct rows so far, and their share, after each position of a run.

    ``order`` is the position of a row in its run, of any type that can be sorted; rows that share one are reported
    together, rows without position or group are left out. The rows move once, in ranges of (group, position).
    """
    keyed = results.where(" and ".join(f"`{c}` is not null" for c in [*by, order]))
    steps = keyed.select(
        *by, order, F.lit(1).cast("long").alias("_rows"), F.coalesce(F.col("correct").cast("long"), F.lit(0)).alias("_hits")
    )
    out = running_sums(steps, by, [order], {"processed": "_rows", "correct": "_hits"}, partitions, last_of_ties=True)
    share = (F.col("correct") / F.col("processed")).alias("running_accuracy")
    return out.select(*by, order, "processed", "correct", share)
