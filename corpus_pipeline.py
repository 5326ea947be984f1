"""The corpus pipeline: every stage takes all its predecessor kept and writes Parquet.

toxicity -> n-gram Jaccard join -> benchmark decontamination -> mixing -> sharding.
All but the last stage return the columns of ``documents``; repeats of the mix
are repeated rows. Null and empty texts pass every filter; repeated rows, repeated
doc_ids and rows without one are rows of their own in the dedup stage; an empty table
passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from quarry.llm.catalogue import MIX_BUDGET, MIX_EPOCHS, MIX_WEIGHTS, SHARDS
from quarry.llm.common import read_table, small
from quarry.session import ensure_checkpoint_dir, ship_package, stage_table

#: Training and sampling are not SQL; planted rows are followed through every stage in the tests.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject (6)."""
    _ready(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (the least doc_id, rows without one last) of each group of near duplicates (3).
    Rows go by a written key, so repeated rows and doc_ids and missing ones are rows like others."""
    _ready(spark)
    rows = stage_table(docs.withColumn("pipe_key", F.monotonically_increasing_id()), "pipe-rows")
    classes = (ngram_join.jaccard_classes(rows.select(F.col("pipe_key").alias("doc_id"), "text"))
               .select(F.col("doc_id").alias("c_key"), F.col("component_id").alias("c_group")))
    # only groups of several rows; their tables have a row a group and are broadcast if they are
    # small, so a large group's rows stay where they are
    classes = stage_table(classes, "pipe-classes")
    shared = stage_table(classes.groupBy("c_group").agg(F.count(F.lit(1)).alias("c_rows")).filter("c_rows > 1"), "pipe-shared")
    grouped = stage_table(classes.join(small(shared), "c_group").join(
        rows.select("pipe_key", "doc_id"), F.col("c_key") == F.col("pipe_key"))
        .select("c_group", "c_key", "doc_id"), "pipe-groups")
    kept = stage_table(grouped.groupBy("c_group").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "c_key"))["c_key"].alias("kept")), "pipe-kept")
    losers = stage_table(grouped.join(small(kept), "c_group").filter(F.col("c_key") != F.col("kept"))
                         .select(F.col("c_key").alias("loser")), "pipe-losers")
    return rows.join(small(losers), F.col("pipe_key") == F.col("loser"), "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (7)."""
    _ready(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, repeats as rows (2)."""
    _ready(spark)
    return mixing.repeat_rows(docs, mixing.mixture(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS))


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' shards and slots (1)."""
    _ready(spark)
    return sharding.kd_shards(docs, shards=SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each hand-off a staged Parquet table."""
    _ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipe-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
