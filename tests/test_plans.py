"""Plan-shape guards: no query of the catalogue plans a cross product, and the
retrieval plans keep their intended shape."""

import contextlib
import io
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_no_cross_products_anywhere(spark):
    import __spark_entry__ as E
    bad = []
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def _vectors(spark, name):
    return spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr(f"vec_id AS {name}", "embedding")


def test_top_k_scans_the_corpus_where_it_lies(spark):
    from quarry.operators.retrieve import top_k
    plan = _plan(top_k(_vectors(spark, "query_id"), _vectors(spark, "ctx_id"), 5))
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    assert plan.count("WindowGroupLimit") >= 2      # partial limit before the shuffle, final after
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1              # the candidates only
    below = tree[tree.index("MapInArrow"):]
    assert "Exchange" not in below


def test_large_query_sides_meet_in_blocks(spark):
    from quarry.operators.retrieve import top_k
    plan = _plan(top_k(_vectors(spark, "query_id"), _vectors(spark, "ctx_id"), 5, query_bytes=0))
    assert "FlatMapCoGroupsInArrow" in plan
    assert "REPARTITION_BY_NUM" in plan


def test_eval_set_is_narrow(spark):
    import __spark_entry__ as E
    tree = _plan(E.queries()["eval_set"](spark, SF)).split("\n\n\n")[0]
    # only the optional spreading of a single-file scan may shuffle
    assert tree.count("Exchange") <= 1
    assert "Generate" in tree


def test_slices_of_queries_scan_the_corpus_without_an_exchange(spark):
    from quarry.operators.retrieve import top_k
    q, c = _vectors(spark, "query_id"), _vectors(spark, "ctx_id")
    plan = _plan(top_k(q, c, 5, query_bytes=100_000))
    tree = plan.split("\n\n\n")[0]
    assert tree.count("MapInArrow") > 1 and "FlatMapCoGroups" not in tree and tree.count("Exchange") == 1
    same = top_k(q, c, 5, query_bytes=100_000).exceptAll(top_k(q, c, 5))
    assert same.count() == 0
