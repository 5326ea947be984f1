"""Joins on keys of which a few hold much of the rows.

:func:`heavy_hitters` finds every key with at least a given share of the rows: each task
keeps a Misra-Gries sketch of a fixed number of counters over its Arrow batches, the
sketches are added up by key, and the keys that may reach the share are counted exactly.
:func:`salted_join` spreads just those keys: a heavy key's rows are dealt round-robin to
as many pieces as it deserves, the other side's row is repeated once a piece, and the
salts are chosen so that the pieces of a key fall on different shuffle partitions (a
plain salt would let them collide). All other rows join as they are. No help of
adaptive execution is needed; with it nothing is left to split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import stage_table

COUNTERS = 1024
BROADCAST_ROWS = 100_000      # narrow rows of a side that is broadcast
PIECES = 2                    # pieces of a heavy key per fair partition load


def misra_gries(table: pa.Table, counters: int) -> tuple[pa.Table, int]:
    """One step of the sketch: ``key, n`` cut to at most ``counters`` rows; a key loses at
    most the returned count (the largest one that did not fit)."""
    if table.num_rows <= counters:
        return table, 0
    n = table["n"].to_numpy()
    lost = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    table = table.set_column(1, "n", pc.subtract(table["n"], lost))
    return table.filter(pc.greater(table["n"], 0)), lost


def _sketched(counters: int):
    def sketch(batches):
        kept = pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        lost = rows = 0
        for batch in batches:
            keys = pc.cast(batch.column(0).drop_null(), pa.string())
            rows += len(keys)
            seen = pc.value_counts(keys)
            seen = pa.table({"key": seen.field("values"), "n": seen.field("counts")})
            both = pa.concat_tables([kept, seen]).group_by("key").aggregate([("n", "sum")])
            kept, more = misra_gries(both.select(["key", "n_sum"]).rename_columns(["key", "n"]), counters)
            lost += more
        yield from pa.table({"key": pc.cast(kept["key"], pa.string()), "n": kept["n"], "lost": pa.array([0] * len(kept), pa.int64()),
                             "rows": pa.array([0] * len(kept), pa.int64())}).to_batches()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([0]), pa.array([lost]), pa.array([rows])],
                                         names=["key", "n", "lost", "rows"])
    return sketch


@dataclass
class Heavy:
    """Heavy keys as strings with their exact counts, most frequent first, and the rows that have a key."""

    keys: list[tuple[str, int]]
    total: int


def heavy_hitters(df: DataFrame, key: str, share: float, counters: int | None = None) -> Heavy:
    """Every key (string or integer) of ``df`` on at least ``share`` of its rows - at most
    1 / share keys. Reads the key column twice: hand in a written table. Null keys join
    nothing and are not counted."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0, at most 1")
    keys = df.select(F.col(key).cast("string").alias("key"))
    # a sketch of 4 / share counters loses at most a quarter of the share
    sketch = keys.mapInArrow(_sketched(counters or max(COUNTERS, math.ceil(4 / share))),
                             "key string, n bigint, lost bigint, rows bigint")
    merged = stage_table(sketch.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "lost", "rows")]), "heavy")
    t = merged.filter(F.col("key").isNull()).first()
    lost, total = (t["lost"], t["rows"]) if t else (0, 0)
    maybe = [r["key"] for r in merged.filter(F.col("key").isNotNull() & (F.col("n") > 0) & (F.col("n") + lost >= share * total))
             .select("key").collect()]
    if not maybe:
        return Heavy([], total)
    exact = (keys.filter(F.col("key").isin(maybe)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") >= share * total).orderBy(F.desc("n"), "key").collect())
    return Heavy([(r["key"], r["n"]) for r in exact], total)


def heavy_counts(df: DataFrame, key: str, share: float) -> Heavy:
    """:func:`heavy_hitters` by counting every key (partially combined before the exchange): for
    narrow tables, where one grouping costs less than a sketch and a second look."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0, at most 1")
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(key)).first()[0]
    # at most 1 / share keys
    found = n.filter(F.col("n") >= share * rows).orderBy(F.desc("n"), key).collect() if rows else []
    return Heavy([(str(r[key]), r["n"]) for r in found], rows)


def choose_salts(spark: SparkSession, heavy: Heavy, kind: str, partitions: int) -> list[tuple[str, list[int]]]:
    """Salts of the heavy keys: a key gets PIECES pieces for each fair partition load it holds (at
    most one a partition), each piece on another partition, the least loaded ones first."""
    fair = max(1.0, heavy.total / partitions)
    pieces = [(k, n, min(partitions, math.ceil(PIECES * n / fair))) for k, n in heavy.keys]
    pieces = [p for p in pieces if p[2] > 1]
    if not pieces:
        return []
    # where each salt would put the key: Spark's own hash partitioning of (key, salt)
    tries = 16 * partitions + 64
    spots = (spark.createDataFrame([(k,) for k, _, _ in pieces], "k string")
             .select("k", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("salt"))
             .select("k", "salt", F.pmod(F.hash(F.col("k").cast(kind), F.col("salt")), F.lit(partitions)).alias("at"))
             .groupBy("k", "at").agg(F.min("salt").alias("salt")).collect())
    found: dict[str, dict[int, int]] = {}
    for r in spots:
        found.setdefault(r["k"], {})[r["at"]] = r["salt"]
    load, out = np.zeros(partitions), []
    for k, n, want in pieces:
        at = sorted(found[k], key=lambda p: (load[p], p))[:want]
        load[at] += n / len(at)
        out.append((k, [found[k][p] for p in at]))
    return out


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_share(df: DataFrame) -> float:
    """From which share of the rows on a key is worth spreading: a quarter of a fair partition load."""
    return max(1e-4, 1 / (4 * _partitions(df)))


def salted_join(big: DataFrame, small: DataFrame, on: str, heavy: Heavy | list, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` on the column ``on``, the heavy keys of ``big`` spread.
    ``how``: inner, left, left_semi or left_anti. ``big`` must be a written table (its rows'
    order is the same whenever a task is run again, so the deal is too). ``heavy`` may also be
    the salts that :func:`choose_salts` gave for these keys before."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must keep the big side: inner, left, left_semi or left_anti")
    spark, kind = big.sparkSession, big.schema[on].dataType.simpleString()
    salts = heavy if isinstance(heavy, list) else choose_salts(spark, heavy, kind, _partitions(big))
    if not salts:
        return big.join(small, on, how)
    # at most 1 / share rows
    table = F.broadcast(spark.createDataFrame(salts, "k string, _salts array<int>").select(F.col("k").cast(kind).alias("_k"), "_salts"))
    turn = F.pmod(F.monotonically_increasing_id(), F.size("_salts")).cast("int")
    dealt = (big.join(table, F.col(on) == F.col("_k"), "left")
             .withColumn("_salt", F.coalesce(F.get("_salts", turn), F.lit(0))).drop("_k", "_salts"))
    copies = (small.join(table, F.col(on) == F.col("_k"), "left")
              .withColumn("_salt", F.explode(F.coalesce("_salts", F.array(F.lit(0))))).drop("_k", "_salts"))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def keyed_join(big: DataFrame, small: DataFrame, on: str, small_rows: int, how: str = "inner",
               share: float | None = None) -> DataFrame:
    """Join a written ``big`` with ``small`` (narrow, of a known row count): broadcast if it
    is small enough, else with the heavy keys salted. ``share``: from which share on a key
    is heavy (default: a quarter of a fair partition load)."""
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, heavy_hitters(big, on, share or heavy_share(big)), how)
