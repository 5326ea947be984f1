"""Model comparison (M11-M16): means, improvements, leaderboard, best picks.

All inputs here are already aggregated (a few rows per model and metric),
so the pivots, orderings and single-row limits below are cheap by
construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_means(long_metrics: DataFrame, models: tuple[str, ...] = (),
                metrics: tuple[str, ...] = ()) -> DataFrame:
    """``model, metric, metric_pos, value`` = mean per model and metric. Every
    combination of the given ``models`` and ``metrics`` is reported, 0 when it has no
    rows."""
    zeros = [(m, x, i) for m in models for i, x in enumerate(metrics)]
    rows = long_metrics.select("model", "metric", F.col("metric_pos").cast("int").alias("metric_pos"), "value")
    if zeros:
        rows = rows.unionByName(long_metrics.sparkSession.createDataFrame(
            zeros, "model string, metric string, metric_pos int").withColumn("value", F.lit(None).cast("double")))
    return (rows.groupBy("model", "metric")
            .agg(F.min("metric_pos").alias("metric_pos"),
                 F.coalesce(F.avg("value"), F.lit(0.0)).alias("value")))


def wide_to_long(wide: DataFrame, metric_cols: list[str], names: list[str] | None = None,
                 ids: tuple[str, ...] = ("model",)) -> DataFrame:
    """Metric columns of a per-model table to ``model, metric, metric_pos, value``."""
    names = names or metric_cols
    items = [F.struct(F.lit(n).alias("metric"), F.lit(i).alias("metric_pos"),
                      F.col(c).cast("double").alias("value"))
             for i, (c, n) in enumerate(zip(metric_cols, names))]
    return wide.select(*ids, F.inline(F.array(*items)))


def improvement(means: DataFrame, base: str, candidate: str) -> DataFrame:
    """``metric, metric_pos, base, candidate, absolute, relative`` where
    relative is in percent and 0 when the base is 0 (never a bare division)."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    p = means.groupBy("metric").agg(F.min("metric_pos").alias("metric_pos"), of(base).alias("_b"), of(candidate).alias("_c"))
    b, c = F.coalesce(F.col("_b"), F.lit(0.0)), F.coalesce(F.col("_c"), F.lit(0.0))
    return (p.select("metric", "metric_pos", b.alias("base"), c.alias("candidate"),
                     (c - b).alias("absolute"),
                     F.coalesce(F.try_divide(c - b, b) * F.lit(100.0), F.lit(0.0)).alias("relative")))


def best_model(board: DataFrame, by: str = "mrr") -> DataFrame:
    """The model with the highest ``by``; the earlier model wins ties."""
    return board.orderBy(F.col(by).desc(), F.col("model_pos").asc()).limit(1)


def best_metric(impr: DataFrame) -> DataFrame:
    """Metric with the highest relative improvement among those with a
    non-zero base (earlier metric wins ties); 'n/a' when there is none."""
    cands = impr.filter(F.col("base") != 0).select("metric", "relative", "metric_pos",
                                                   F.lit(0).alias("_prio"))
    spark = impr.sparkSession
    fallback = spark.createDataFrame([("n/a", None, 1 << 30, 1)],
                                     "metric string, relative double, metric_pos int, _prio int")
    return (cands.unionByName(fallback)
                 .orderBy("_prio", F.col("relative").desc(), "metric_pos").limit(1)
                 .select("metric", "relative"))


def one_metric(impr: DataFrame, name: str = "simulated_faithfulness") -> DataFrame:
    """The comparison row of one metric."""
    return impr.filter(F.col("metric") == name)
