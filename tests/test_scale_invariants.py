"""Invariants that keep the plans bounded at scale."""

import math

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from quarry.operators import retrieve as R
from quarry.operators.ids import dense_index
from quarry.operators.retrieve import plan_blocks


@pytest.mark.parametrize("nq,nc,cores", [(10, 10, 8), (2000, 2000, 8), (4, 10**6, 8),
                                         (10**6, 10**9, 8000), (10**5, 10**3, 16)])
def test_plan_blocks_bounds(nq, nc, cores):
    qb, cb = plan_blocks(nq, nc, cores, 4096, 16384)
    assert 1 <= qb <= nq and 1 <= cb <= nc
    assert math.ceil(nq / qb) <= 4096 or qb == nq       # query block rows bounded
    assert math.ceil(nc / cb) <= 16384 or cb == nc      # corpus block rows bounded
    assert qb * cb >= min(4 * cores, nq * nc)           # enough block pairs for the cores
    # never moves more rows than the plan with the fewest query blocks the
    # block-row limit allows (queries replicated to every corpus block)
    qb_min, cb_min = math.ceil(nq / 4096), math.ceil(nc / 16384)
    cb_one = min(nc, max(cb_min, math.ceil(4 * cores / qb_min)))
    if qb_min * cb_one >= 4 * cores:   # compare plans that both reach the parallelism target
        assert nq * cb + nc * qb <= nq * cb_one + nc * qb_min


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_dense_index_equals_global_row_number(spark, parts):
    df = spark.range(0, 500).select(F.pmod(F.col("id") * 7919, F.lit(100003)).alias("k"))
    got = dense_index(df, ["k"], out="i", num_partitions=parts).collect()
    expected = {k: i for i, k in enumerate(sorted(r.k for r in got))}
    assert all(r.i == expected[r.k] for r in got)
    assert sorted(r.i for r in got) == list(range(500))


def _pair_sides(spark, n_q, n_c):
    vector = F.array(*[F.lit(0.5).cast("float") for _ in range(4)])
    return (spark.range(n_q).select(F.col("id").alias("query_id"), vector.alias("embedding")),
            spark.range(n_c).select(F.col("id").alias("ctx_id"), vector.alias("embedding")))


def test_blocks_hold_what_a_task_can(spark, monkeypatch):
    """Rows are moved once per block of the other side: blocks of a few thousand rows moved millions of
    vectors hundreds of times."""
    seen = []

    def plan(n_q, n_c, cores, q_rows, c_rows):
        seen.append(plan_blocks(2_700_000, 2_800_000, 12, q_rows, c_rows))
        return 1, 1

    monkeypatch.setattr(R, "plan_blocks", plan)
    q, c = (x.withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 96)) for x in _pair_sides(spark, 3, 3))
    assert R.top_k(q, c, 5, query_bytes=0).count() == 9
    qb, cb = seen[0]
    assert qb <= 20 and cb <= 12


def test_every_block_pair_has_a_task_of_its_own(spark):
    def where(q, c):
        return pa.table({"at": [TaskContext.get().partitionId()], "pairs": [q.num_rows * c.num_rows]})

    q, c = _pair_sides(spark, 60, 200)
    got = R._blocked(q, c, 4, 9).applyInArrow(where, "at bigint, pairs bigint").collect()
    assert len({r["at"] for r in got}) == len(got) == 36
    assert sum(r.pairs for r in got) == 60 * 200
