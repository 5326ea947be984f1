"""Metric families (M1-M17) against plain-Python models of the formulas."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.compare import best_metric, best_model, improvement, model_means
from quarry.operators.metrics import (dataset_composition, evaluate_multi, evaluate_rowwise,
                                      multi_query_metrics, rowwise_columns, simulated_metrics)
from tests.test_retrieve import _vecs


def test_rowwise_cases(spark):
    cases = [(1, 1.0), (5, 1.0), (None, 1.0), (1, 0.0), (5, 0.0), (None, 0.0), (3, 0.5)]
    df = spark.createDataFrame(cases, "rank int, relevance double")
    got = df.select(*rowwise_columns(F.col("rank"), F.col("relevance"))).collect()
    for (rank, rel), r in zip(cases, got):
        for k, v in ((1, r.p_at_1), (3, r.p_at_3), (5, r.p_at_5)):
            hit = rank is not None and rank <= k
            exp = (1.0 / k if hit else 0.0) if rel == 1.0 else (0.0 if hit else 1.0)
            assert v == exp
        ok = rel == 1.0 and rank is not None and rank <= 5
        assert r.mrr == (1.0 / rank if ok else 0.0)
        assert abs(r.ndcg_at_5 - (1 / math.log2(rank + 1) if ok else 0.0)) < 1e-12


def _fixture(spark, seed=5):
    rng = np.random.default_rng(seed)
    qv = rng.normal(size=(12, 6))
    cv = rng.normal(size=(30, 6))
    rows = []
    rid = 0
    for qi in range(12):
        for cj in rng.choice(30, size=4, replace=False):
            rows.append((rid, qi, int(cj), float(rng.choice([0.0, 1.0, 1.0, 0.5]))))
            rid += 1
    rows.append((rid, 0, rows[0][2], 0.0))   # duplicate pair, last wins
    r = spark.createDataFrame(rows, "row_id long, query_id long, ctx_id long, relevance double")
    return r, rows, _vecs(spark, qv, "query_id"), _vecs(spark, cv, "ctx_id"), qv, cv


def _py_multi(rows, qv, cv):
    judg = {}
    for rid, q, c, rel in sorted(rows):
        judg[(q, c)] = rel
    s = qv @ cv.T
    ctxs = sorted({c for _, _, c, _ in rows})
    tot = dict(p1=0.0, p3=0.0, p5=0.0, mrr=0.0, ndcg=0.0)
    for _, q, _, _ in rows:
        order = sorted(ctxs, key=lambda c: (-s[q, c], c))
        for k, key in ((1, "p1"), (3, "p3"), (5, "p5")):
            tot[key] += sum(1 for c in order[:k] if judg.get((q, c), 0) == 1.0) / k
        for i, c in enumerate(order, 1):
            if judg.get((q, c), 0) == 1.0:
                tot["mrr"] += 1 / i
                break
        rels = [judg.get((q, c), 0) for c in order[:5]]
        ideal = sorted([judg.get((q, c), 0) for c in ctxs], reverse=True)[:5]
        dcg = sum(r / math.log2(i + 1) for i, r in enumerate(rels, 1))
        idcg = sum(r / math.log2(i + 1) for i, r in enumerate(ideal, 1))
        if idcg > 0:
            tot["ndcg"] += dcg / idcg
    return {k: v / len(rows) for k, v in tot.items()}


def test_multi_relevant_matches_python(spark):
    r, rows, q, c, qv, cv = _fixture(spark)
    ctx_ids = sorted({x[2] for x in rows})
    corpus = c.filter(F.col("ctx_id").isin(ctx_ids))
    got = evaluate_multi(r, q, corpus, "dot").first()
    cv_used = cv.astype(np.float32).astype(np.float64)
    exp = _py_multi(rows, qv.astype(np.float32).astype(np.float64), cv_used)
    assert abs(got.p_at_1 - exp["p1"]) < 1e-9 and abs(got.p_at_3 - exp["p3"]) < 1e-9
    assert abs(got.p_at_5 - exp["p5"]) < 1e-9 and abs(got.mrr - exp["mrr"]) < 1e-9
    assert abs(got.ndcg_at_5 - exp["ndcg"]) < 1e-9
    per_q = multi_query_metrics(r, q, corpus, "dot").collect()
    assert all(x.mrr >= x.p_at_1 for x in per_q)


def test_rowwise_mean_bounds_and_repartition(spark):
    r, rows, q, c, _, _ = _fixture(spark)
    a = evaluate_rowwise(r.repartition(1), q, c).first()
    b = evaluate_rowwise(r.repartition(7), q, c).first()
    assert a == b
    for v in (a.p_at_1, a.p_at_3, a.p_at_5, a.mrr, a.ndcg_at_5):
        assert 0.0 <= v <= 1.0


def test_simulated_band_and_empty(spark):
    pairs = spark.createDataFrame([(i, i % 5 == 0, 0.6) for i in range(200)],
                                  "row_id long, context_empty boolean, similarity double")
    out = simulated_metrics(pairs, "m").collect()
    for r in out:
        if r.row_id % 5 == 0:
            assert r.value == 0.0
        elif r.metric == "simulated_context_recall":
            assert 0.9 * 0.6 - 0.05 <= r.value <= 0.9 * 0.6 + 0.05
        elif r.metric == "similarity":
            assert r.value == 0.6
    means = model_means(simulated_metrics(pairs, "a").unionByName(simulated_metrics(pairs, "a")
                                                                    .withColumn("model", F.lit("b"))))
    same = improvement(means, "a", "b").collect()
    assert all(x.absolute == 0.0 and x.relative == 0.0 for x in same)


def test_improvement_zero_base_and_best_picks(spark):
    m = spark.createDataFrame([("a", "x", 0, 0.0), ("b", "x", 0, 0.5), ("a", "y", 1, 0.2),
                               ("b", "y", 1, 0.3), ("a", "z", 2, 0.1), ("b", "z", 2, 0.15)],
                              "model string, metric string, metric_pos int, value double")
    imp = {r.metric: r for r in improvement(m, "a", "b").collect()}
    assert imp["x"].relative == 0.0 and abs(imp["y"].relative - 50.0) < 1e-9
    bm = best_metric(improvement(m, "a", "b")).first()
    assert bm.metric == "y"          # tie with z (50%): earlier metric wins
    none = spark.createDataFrame([("a", "x", 0, 0.0), ("b", "x", 0, 0.5)],
                                 "model string, metric string, metric_pos int, value double")
    assert best_metric(improvement(none, "a", "b")).first().metric == "n/a"
    board = spark.createDataFrame([("m1", 0, 0.5), ("m2", 1, 0.5), ("m3", 2, 0.4)],
                                  "model string, model_pos int, mrr double")
    assert best_model(board).first().model == "m1"


def test_dataset_composition(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,), (0.5,)], "relevance double")
    r = dataset_composition(df).first()
    assert (r.total_examples, r.positive_examples, r.negative_examples) == (4, 2, 1)


def test_hot_query_skew_matches_python(spark):
    """One query id in a third of the rows (and duplicate pairs): results stay
    equal to the plain-Python model of both families."""
    rng = np.random.default_rng(11)
    qv = rng.normal(size=(20, 5))
    cv = rng.normal(size=(40, 5))
    rows = []
    for rid in range(300):
        q = 0 if rid % 3 == 0 else int(rng.integers(1, 20))
        c = int(rng.integers(0, 40))
        rows.append((rid, q, c, float(rng.choice([0.0, 1.0]))))
    r = spark.createDataFrame(rows, "row_id long, query_id long, ctx_id long, relevance double")
    q = _vecs(spark, qv, "query_id")
    ctx_ids = sorted({x[2] for x in rows})
    c = _vecs(spark, cv, "ctx_id").filter(F.col("ctx_id").isin(ctx_ids))
    got = evaluate_multi(r, q, c, "dot").first()
    exp = _py_multi(rows, qv.astype(np.float32).astype(np.float64), cv.astype(np.float32).astype(np.float64))
    assert abs(got.mrr - exp["mrr"]) < 1e-9 and abs(got.ndcg_at_5 - exp["ndcg"]) < 1e-9
    assert abs(got.p_at_1 - exp["p1"]) < 1e-9 and abs(got.p_at_5 - exp["p5"]) < 1e-9
    # row-judged: mean over rows of the per-row formula with the own rank in the top 5
    s = qv.astype(np.float32).astype(np.float64) @ cv.astype(np.float32).astype(np.float64).T
    qn = np.linalg.norm(qv.astype(np.float32).astype(np.float64), axis=1)
    cn = np.linalg.norm(cv.astype(np.float32).astype(np.float64), axis=1)
    cos = s / np.outer(qn, cn)
    tot = 0.0
    for _, qi, ci, rel in rows:
        order = sorted(ctx_ids, key=lambda j: (-cos[qi, j], j))[:5]
        rank = order.index(ci) + 1 if ci in order else None
        tot += (1 / rank if (rel == 1.0 and rank) else 0.0)
    assert abs(evaluate_rowwise(r, q, c).first().mrr - tot / len(rows)) < 1e-9
