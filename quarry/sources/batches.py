"""Training batches as files (T6): Parquet by epoch and range of batches, with a manifest.

``<path>/data/epoch=<e>/batch_range=<r>`` holds the batches ``r * per_file`` to
``(r + 1) * per_file - 1`` of an epoch in one file, sorted by batch and position, so a loader reads
one batch by opening one file; ``<path>/manifest`` lists the ranges with their rows.
Files hold ``per_file`` batches whatever the size of the set, and every range is written by
one task of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCHES_PER_FILE = 1000


def write_batches(rows: DataFrame, path: str, per_file: int = BATCHES_PER_FILE) -> None:
    """``rows`` with ``epoch, batch_id, position`` (see ``operators.training.mini_batches``)
    and any other columns. An earlier set at ``path`` is replaced."""
    if per_file < 1:
        raise ValueError("per_file must be at least 1")
    path, spark = path.rstrip("/"), rows.sparkSession
    ranged = rows.withColumn("batch_range", F.expr(f"batch_id div {per_file}"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ranged.schema
    (ranged.repartition(n, "epoch", "batch_range").sortWithinPartitions("epoch", "batch_range", "batch_id", "position")
     .write.mode("overwrite").partitionBy("epoch", "batch_range").parquet(f"{path}/data"))
    written = spark.read.schema(schema).parquet(f"{path}/data")
    (written.groupBy("epoch", "batch_range").agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"),
                                                 F.count(F.lit(1)).alias("rows"))
     .withColumn("per_file", F.lit(per_file)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, batch_range, first_batch, last_batch, rows, per_file``."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def read_batches(spark: SparkSession, path: str, epoch: int | None = None, first: int | None = None,
                 last: int | None = None) -> DataFrame:
    """The rows of batches ``first`` to ``last`` (each optional) of an epoch (or all). Only the
    files of their ranges are read."""
    path = path.rstrip("/")
    data = spark.read.parquet(f"{path}/data")
    if epoch is not None:
        data = data.filter(F.col("epoch") == epoch)
    if first is not None or last is not None:
        per = read_manifest(spark, path).select("per_file").first()
        per = per["per_file"] if per else 1
        if first is not None:
            data = data.filter((F.col("batch_range") >= first // per) & (F.col("batch_id") >= first))
        if last is not None:
            data = data.filter((F.col("batch_range") <= last // per) & (F.col("batch_id") <= last))
    return data.drop("batch_range")
