"""Exact keys at given ranks, without sorting or shuffling the wide rows.

Limits per class, stratified folds and exact-size splits all ask the same thing:
"which key is at rank r of its group?".  A window over the group would send a whole
class through one task.  Here the answer takes a few narrow passes:

1. one partially aggregated pass gives every group's size and a quantile sketch,
   from which each wanted rank gets a bracket of keys that is sure to contain it;
2. further passes count the rows below the bracket and sketch the rows inside, which narrows it
   to about ``4 / GRID`` of what it was, each time;
3. the last pass ranks only the rows left inside: ``(4 / GRID) ** NARROWINGS`` of the group.

The result has one row per group and rank, so applying it is a broadcast lookup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 1000
ACCURACY = 10 * GRID
NARROWINGS = 2  # of a group of 10^11 rows, about 10^6 are left to rank


def _bracket(share: Column, low: Column, high: Column) -> list[Column]:
    """Bounds around a share of the sketched rows; the old ones at the sketch's ends."""
    cell = share * GRID
    lower, upper = F.floor(cell).cast("int") - 1, F.ceil(cell).cast("int") + 1
    return [
        F.when(lower > 0, F.get("sketch", lower)).otherwise(low).alias("low"),
        F.when(upper < GRID, F.get("sketch", upper)).otherwise(high).alias("high"),
    ]


def key_at_ranks(
    df: DataFrame,
    group: str,
    key: str,
    position: str,
    ranks: Callable[[Column], list[Column]],
) -> DataFrame:
    """Key of the r-th smallest row per group: ``(group, slot, rank, n, key)``.

    ``group``     a column with few values (a class label or a constant);
    ``key``       unique within the group; ``position`` is a number that never
                  decreases as ``key`` grows, used for the sketch (may be ``key``);
    ``ranks``     the wanted 1-based ranks, from the group's row count. Ranks outside
                  ``1..n`` give no row.
    """
    narrow = df.select(
        F.col(group).alias("group"),
        F.col(key).alias("key"),
        F.col(position).cast("double").alias("position"),  # as the sketch keeps it
    )
    grid = [i / GRID for i in range(GRID + 1)]
    sizes = narrow.groupBy("group").agg(
        F.count("*").alias("n"), F.percentile_approx("position", grid, ACCURACY).alias("sketch")
    )
    wanted = (
        sizes.select(
            "group", "n", "sketch", F.posexplode(F.array(*ranks(F.col("n")))).alias("slot", "rank")
        )
        .where("rank between 1 and n")
        .select(
            "group",
            "slot",
            F.col("rank").cast("long").alias("rank"),
            "n",
            *_bracket(F.col("rank") / F.col("n"), F.lit(None).cast("double"), F.lit(None).cast("double")),
        )
    )
    below = F.coalesce(F.col("position") < F.col("low"), F.lit(False))
    above = F.coalesce(F.col("position") > F.col("high"), F.lit(False))
    candidates = narrow.join(F.broadcast(wanted), "group")  # one row per group and rank
    for _ in range(NARROWINGS - 1):
        inside_only = F.when(~below & ~above, F.col("position"))
        counted = candidates.groupBy("group", "slot").agg(
            F.first("rank").alias("rank"),
            F.first("n").alias("n"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
            F.count_if(below).alias("below"),
            F.count(inside_only).alias("inside"),
            F.percentile_approx(inside_only, grid, ACCURACY).alias("sketch"),
        )
        share = (F.col("rank") - F.col("below")) / F.col("inside")
        wanted = counted.select("group", "slot", "rank", "n", *_bracket(share, F.col("low"), F.col("high")))
        candidates = narrow.join(F.broadcast(wanted), "group")
    targets = (
        candidates.groupBy("group", "slot")
        .agg(F.first("rank").alias("rank"), F.first("n").alias("n"), F.count_if(below).alias("below"))
        .withColumn("place", F.col("rank") - F.col("below"))
    )
    order = Window.partitionBy("group", "slot").orderBy("key")
    inside = (
        candidates.where(~below & ~above)
        .select("group", "slot", "key")
        .withColumn("place", F.row_number().over(order).cast("long"))
    )
    outside = F.raise_error(F.lit("rank outside its bracket"))
    return targets.join(inside, ["group", "slot", "place"], "left").select(
        F.col("group").alias(group),
        "slot",
        "rank",
        "n",
        F.when(F.col("key").isNull(), outside).otherwise(F.col("key")).alias("key"),
    )
