"""The cell index returns the rows of the plain top-k, whatever it skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.cell_index import _bounds, build_index, pruned_top_k
from quarry.operators.retrieve import top_k


def _frame(spark, name, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)],
                                 f"{name} bigint, embedding array<double>").repartition(4).checkpoint()


def _rows(df):
    return sorted((r.query_id, r["rank"], r.ctx_id, r.score) for r in df.collect())


def _clustered(n, d=16, centers=12, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centers, d))
    return c[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, d))


@pytest.mark.parametrize("similarity", ["cosine", "dot"])
def test_clusters_are_skipped_and_hits_are_exact(spark, similarity):
    m = _clustered(1200)
    q, c = _frame(spark, "query_id", m[:150]), _frame(spark, "ctx_id", m)
    hits, report = pruned_top_k(q, build_index(c, similarity, cells=30), 5)
    assert _rows(hits) == _rows(top_k(q, c, 5, similarity))
    r = report.first()
    assert r.queries == 150 and r.pairs == r.queries * r.cells and 0 < r.scored_pairs < r.pairs
    assert r.skipped_share > (0.8 if similarity == "cosine" else 0.3)


@pytest.mark.parametrize("similarity", ["cosine", "dot"])
def test_ties_zero_vectors_and_a_hot_cell(spark, similarity):
    m = _clustered(60, d=4, centers=3, seed=2)
    c = np.concatenate([m, m, np.zeros((5, 4)), np.tile(m[0], (300, 1)), -m[:10]])
    q = np.concatenate([m[:20], np.zeros((2, 4)), -m[:5]])
    q, c = _frame(spark, "query_id", q), _frame(spark, "ctx_id", c, ids=list(range(1000, 1000 + len(c))))
    hits, _ = pruned_top_k(q, build_index(c, similarity, cells=9), 4)
    assert _rows(hits) == _rows(top_k(q, c, 4, similarity))


def test_query_slices_and_few_contexts(spark):
    m = _clustered(40, d=8, centers=4, seed=3)
    q, c = _frame(spark, "query_id", m), _frame(spark, "ctx_id", m[:3])
    hits, report = pruned_top_k(q, build_index(c), 5, query_bytes=1000)
    assert _rows(hits) == _rows(top_k(q, c, 5))
    assert report.first().queries == 40


def test_empty_corpus_and_no_queries(spark):
    m = _clustered(10, d=3, centers=2)
    none = _frame(spark, "ctx_id", m).filter("ctx_id < 0")
    hits, report = pruned_top_k(_frame(spark, "query_id", m), build_index(none), 5)
    assert hits.count() == 0 and report.first().skipped_share == 0
    hits, report = pruned_top_k(_frame(spark, "query_id", m).filter("query_id < 0"), build_index(_frame(spark, "ctx_id", m)), 5)
    assert hits.count() == 0 and report.first().queries == 0


@pytest.mark.parametrize("cosine", [True, False])
def test_no_member_is_above_its_bound(cosine):
    rng = np.random.default_rng(1)
    for _ in range(30):
        m, q = rng.normal(size=(40, 6)), rng.normal(size=(20, 6))
        if cosine:
            m, q = (x / np.linalg.norm(x, axis=1)[:, None] for x in (m, q))
        center = m[:8].mean(axis=0)[None, :]
        if cosine:
            center /= np.linalg.norm(center)
        r = np.sqrt(((m[:8] - center) ** 2).sum(axis=1)).max()
        top, slack = _bounds(q, center, np.array([r]), cosine)
        assert ((q @ m[:8].T).max(axis=1) <= top[:, 0] + slack).all()


def test_every_row_is_indexed(spark):
    c = _frame(spark, "ctx_id", _clustered(500))
    index = build_index(c, cells=10)
    assert index.rows == 500 and index.table.select("ctx_id").distinct().count() == 500
    far = index.table.groupBy("cell").agg(F.max("dist").alias("d")).collect()
    assert all(index.radius[r.cell] == r.d for r in far)


def test_wanted_cells_are_a_bit_each(spark):
    from quarry.operators.cell_index import _bits, _needs
    m = _clustered(300, d=6, centers=6)
    index = build_index(_frame(spark, "ctx_id", m), cells=11)
    q = _frame(spark, "query_id", m[:40]).selectExpr("query_id", "embedding AS q_vec", "0.9D AS thr")
    need = _needs(q, index, 5, 2)
    assert dict(need.dtypes)["probed"] == dict(need.dtypes)["cells"] == "binary"
    t = need.toArrow()
    bits = [np.unpackbits(_bits(t[c], len(index.centroids)).T, axis=1) for c in ("probed", "cells")]
    assert (bits[0].sum(axis=1) == 2).all() and not (bits[0] & bits[1]).any()
    assert (bits[0] | bits[1]).sum(axis=1).tolist() == t["n"].to_pylist()
