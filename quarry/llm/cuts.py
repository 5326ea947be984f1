"""Distributed weighted quantiles: the key at which a group's running weight
reaches a target, found by histogram refinement.

Each round counts the weight of 4,096 key ranges per group (combined before
the shuffle), picks the range in which the target falls and looks into that
range only, so no row is sorted or moved and no group is gathered in a task,
however large it is. Rounds end as soon as every chosen range holds a single
key; keys have KEY_BITS bits, so there are at most five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stage_table

KEY_BITS = 60
ROUND_BITS = 12
PAST_END = 1 << KEY_BITS


def weighted_cuts(points: DataFrame, targets: DataFrame) -> DataFrame:
    """``points``: ``grp, key (0 <= key < 2**60), weight (bigint >= 0)``;
    ``targets``: ``grp, target double``. Returns ``grp, target, cut, below, atom``:
    ``cut`` is the least key whose running weight (through the key) reaches the
    target, ``below`` the weight of smaller keys, ``atom`` the weight of the key
    itself. A target beyond the whole weight gives ``cut = 2**60``, atom 0; a
    target of 0 or less gives cut 0, below 0, atom 0. ``grp`` may be null (it is
    compared null-safely). Groups without points are past the end."""
    state = targets.select("grp", "target", F.lit(0).cast("bigint").alias("lo"),
                           F.lit(0).cast("bigint").alias("below"),
                           F.lit(0).cast("bigint").alias("atom"),
                           (F.col("target") <= 0).alias("done"))
    for shift in range(KEY_BITS - ROUND_BITS, -1, -ROUND_BITS):
        todo = state.filter(~F.col("done")).select(F.col("grp").alias("g"), "lo", "target", "below")
        parts = (points.join(todo, points["grp"].eqNullSafe(todo["g"]))
                 .filter(F.shiftright("key", shift + ROUND_BITS) == F.shiftright("lo", shift + ROUND_BITS))
                 .groupBy("g", F.shiftright("key", shift).alias("part"))
                 .agg(F.sum("weight").alias("w"), F.min("key").alias("k0"), F.max("key").alias("k1"),
                      F.first("target").alias("target"), F.first("below").alias("base")))
        run = Window.partitionBy("g").orderBy("part")
        reached = (parts.withColumn("through", F.col("base") + F.sum("w").over(run))
                   .filter(F.col("through") >= F.col("target"))
                   .groupBy("g").agg(F.min_by(F.struct("part", "w", "k0", "k1", "through"), "part").alias("hit")))
        hit, one = F.col("hit"), F.col("hit.k0") == F.col("hit.k1")
        last = shift == 0
        state = state.join(reached, F.col("grp").eqNullSafe(F.col("g")), "left").select(
            "grp", "target",
            F.when(F.col("done"), F.col("lo")).when(hit.isNull(), F.lit(PAST_END).cast("bigint"))
             .when(one, F.col("hit.k0")).otherwise(F.shiftleft(F.col("hit.part"), shift)).alias("lo"),
            F.when(F.col("done"), F.col("below")).when(hit.isNull(), F.lit(0).cast("bigint"))
             .otherwise(F.col("hit.through") - F.col("hit.w")).alias("below"),
            F.when(F.col("done"), F.col("atom")).when(hit.isNull(), F.lit(0).cast("bigint"))
             .otherwise(F.col("hit.w")).alias("atom"),
            (F.col("done") | hit.isNull() | one | F.lit(last)).alias("done"))
        state = stage_table(state, "cuts")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("grp", "target", F.col("lo").alias("cut"), "below", "atom")
