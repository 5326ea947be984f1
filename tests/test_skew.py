"""Heavy hitters are found whatever the partitioning; salted joins equal plain ones and spread the load."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators.skew import choose_salts, heavy_hitters, keyed_join, misra_gries, salted_join, Heavy
from quarry.session import stage_table


def _keys(spark, keys, parts=5, kind="string"):
    return stage_table(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, v int").repartition(parts))


def _skewed(n=4000, seed=1):
    rng = random.Random(seed)
    return ["hot" if rng.random() < 0.4 else "warm" if rng.random() < 0.1 else f"k{rng.randrange(n)}" for _ in range(n)]


@pytest.mark.parametrize("counters", [40, 1024])
@pytest.mark.parametrize("parts", [1, 7])
def test_every_key_of_the_share_and_no_other(spark, counters, parts):
    keys = _skewed()
    want = sorted(((k, n) for k, n in Counter(keys).items() if n >= 0.05 * len(keys)), key=lambda x: (-x[1], x[0]))
    assert len(want) == 2
    got = heavy_hitters(_keys(spark, keys + [None] * 50, parts), "k", 0.05, counters)
    assert got == Heavy(want, len(keys))


def test_integer_keys_and_empty_tables(spark):
    assert heavy_hitters(_keys(spark, [7] * 9 + [1, 2], kind="bigint"), "k", 0.5).keys == [("7", 9)]
    assert heavy_hitters(_keys(spark, []), "k", 0.5) == Heavy([], 0)
    assert heavy_hitters(_keys(spark, [None, None]), "k", 0.5) == Heavy([], 0)


def test_a_sketch_step_keeps_what_is_frequent():
    t, lost = misra_gries(pa.table({"key": ["a", "b", "c", "d"], "n": [9, 1, 5, 2]}), 2)
    assert lost == 2 and dict(zip(t["key"].to_pylist(), t["n"].to_pylist())) == {"a": 7, "c": 3}
    assert misra_gries(t, 5) == (t, 0)


def test_salts_of_a_key_fall_on_different_partitions(spark):
    heavy = Heavy([("a", 4000), ("b", 1000), ("c", 1)], 10_000)
    salts = dict(choose_salts(spark, heavy, "string", 16))
    assert len(salts["a"]) == 13 and len(salts["b"]) == 4 and "c" not in salts
    for k, s in salts.items():
        at = spark.createDataFrame([(k, x) for x in s], "k string, s int").select(F.pmod(F.hash("k", "s"), F.lit(16))).collect()
        assert len({r[0] for r in at}) == len(s)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_salted_join_equals_the_plain_join(spark, how, kind):
    keys = _skewed(800) + [None, None]
    if kind == "bigint":
        keys = [None if k is None else hash(k) % 1000 if k[0] == "k" else len(k) for k in keys]
    big = _keys(spark, keys, kind=kind)
    there = sorted({k for i, k in enumerate(keys) if k is not None and i % 3}, key=str)
    small = spark.createDataFrame([(k, j) for k in there for j in range(2)], f"k {kind}, w int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = salted_join(big, small, "k", heavy_hitters(big, "k", 0.05), how)
    want = big.join(small, "k", how)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(keyed_join(big, small, "k", 10**6, how)) == rows(want)
    assert rows(keyed_join(big, small, "k", 10, how)) == rows(want)


def test_no_task_holds_the_hot_key(spark):
    """One key on 40 % of the rows, skew splitting and broadcasts off: no task reads more than twice the median."""
    parts, n = 16, 40_000
    confs = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        big = stage_table(spark.range(n).select(F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("v")))
        small = stage_table(big.groupBy("k").agg(F.min("v").alias("w")))
        load = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain = load(big.join(small, "k"))
        spread = load(salted_join(big, small, "k", heavy_hitters(big, "k", 0.01)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(spread) == n
    assert plain[-1] > 5 * plain[len(plain) // 2]
    assert spread[-1] <= 2 * spread[len(spread) // 2]
