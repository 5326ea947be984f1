"""Line dedup by levelled sorted runs of line hashes (native expressions only).

The corpus goes through in batches of documents, each read when its turn comes. A run
is a table bucketed and sorted by line hash with the number of documents that have the
line. A batch's lines are counted, sent to the buckets once, and merge-anti-joined with
each run's keys that already are in enough documents; what is left is added as a new
run. When a level is full its runs are merged bucket by bucket into one of the next level. At the end
the merged counts name the keys to drop. Neither the anti-joins nor the merges move a run's
rows: all runs have the buckets of the session's shuffle partitions. A very common
line is one row per task before any shuffle.

Keys are compared by two independent 64-bit hashes. Defined results: null and
empty texts are one empty line; a blank line (empty key) is never dropped; rows of one
doc_id are one document, each with its own lines; rows without one are documents of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small, spread_tasks
from quarry.session import scratch_dir, stage_counted, stage_table

BATCHES = 4
FANOUT = 2
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(text: Column) -> Column:
    """The text's lines as ``line, h``: two hashes of the line's key, null for an empty
    key. The key is the line without blanks at its ends, A-Z lower-cased (other letters
    kept). One array per step, so nothing inside a lambda is evaluated twice."""
    bare = F.transform(lines_of(text), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("k")))
    ascii_only = lambda k: F.octet_length(k) == F.char_length(k)
    keys = F.transform(bare, lambda s: F.struct(s["line"].alias("line"), F.when(
        ascii_only(s["k"]), F.lower(s["k"])).otherwise(F.translate(s["k"], _UPPER, _LOWER)).alias("k")))
    return F.transform(keys, lambda s: F.struct(s["line"].alias("line"), F.when(s["k"] != "", F.struct(
        F.xxhash64(s["k"]).alias("h1"), F.xxhash64(F.lit(1), s["k"]).alias("h2"))).alias("h")))


def line_hashes(docs: DataFrame, *cols: str) -> DataFrame:
    """``cols, h`` once per document and distinct non-empty key."""
    keys = F.array_distinct(keyed_lines(F.col("text"))["h"])
    return docs.select(*cols, F.explode(keys).alias("h")).filter(F.col("h").isNotNull())


KEY = ["h1", "h2"]


class Run:
    """A bucketed, sorted table ``h1, h2, n``."""

    def __init__(self, rows: DataFrame):
        self.spark, buckets = rows.sparkSession, spread_tasks(rows)
        self.name = f"quarry_line_run_{uuid.uuid4().hex[:12]}"
        (rows.select(*KEY, "n").repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY)
         .option("path", scratch_dir(self.spark, "line-run")).format("parquet").saveAsTable(self.name))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _merged(runs: list[Run]) -> DataFrame:
    """The runs' counts added up, bucket by bucket."""
    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("n", "m").hint("merge"), KEY, "full_outer")
        return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
    return reduce(add, [r.rows() for r in runs])


def _documents_of_lines(docs: DataFrame, twice: DataFrame | None) -> DataFrame:
    """``h1, h2, n``: in how many of ``docs`` each key is found. ``twice``: doc_ids of several rows (null:
    there are none); their rows count as one document."""
    count = lambda rows: rows.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))
    if twice is None:
        return count(line_hashes(docs))
    ids = small(twice).withColumnRenamed("doc_id", "t_id")
    once = line_hashes(docs.join(ids, F.col("doc_id") == F.col("t_id"), "left_anti"), "doc_id").select("h")
    again = line_hashes(docs.join(ids, F.col("doc_id") == F.col("t_id"), "left_semi"), "doc_id").distinct().select("h")
    return count(once.unionByName(again))


def common_lines(docs: DataFrame, min_docs: int, batches: int = BATCHES) -> DataFrame:
    """Hashes ``h1, h2`` of the keys found in at least ``min_docs`` documents; written."""
    docs = docs.select("doc_id", "text")
    twice, n = stage_counted(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
                             .filter("k > 1").select("doc_id"), "line-ids")
    # rows of one doc_id are in one batch; rows without one go by their text
    batch = F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(batches))
    levels: list[list[Run]] = [[]]
    for b in range(batches):
        new = _documents_of_lines(docs.filter(batch == b), twice if n else None)
        for run in (r for level in levels for r in level):
            known = run.rows().filter(F.col("n") >= min_docs).select(*KEY)
            new = new.join(known.hint("merge"), KEY, "left_anti")
        levels[0].append(Run(new))
        i = 0
        while len(levels[i]) == FANOUT:
            if i + 1 == len(levels):
                levels.append([])
            levels[i + 1].append(Run(_merged(levels[i])))
            for old in levels[i]:
                old.drop()
            levels[i] = []
            i += 1
    runs = [r for level in levels for r in level]
    drop = stage_table(_merged(runs).filter(F.col("n") >= min_docs).select(*KEY), "line-drop")
    for run in runs:
        run.drop()
    return drop


def drop_common_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for every row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))       # a row's hits go by doc_id and text
    drop = common_lines(docs, min_docs)
    hits = (line_hashes(docs, "doc_id", "t").join(small(drop), (F.col("h.h1") == F.col("h1")) & (F.col("h.h2") == F.col("h2")))
            .groupBy(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t")).agg(F.collect_set("h").alias("hits")))
    rows = docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]) & (docs["t"] == hits["hit_t"]), "left")
    lines = lines_of(F.col("text"))
    left = F.filter(keyed_lines(F.col("text")), lambda s: ~F.coalesce(F.array_contains("hits", s["h"]), F.lit(False)))
    kept = F.when(F.col("hits").isNull(), lines).otherwise(left["line"])
    return (rows.withColumn("kept_lines", kept)
            .select("doc_id", F.size(lines).cast("bigint").alias("n_lines"),
                    (F.size(lines) - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
                    F.array_join("kept_lines", "\n").alias("kept")))
