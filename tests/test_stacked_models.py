"""All models in one pass: the results of each model alone, and a plan that does not grow with the models."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.encode import HashEncoder
from quarry.operators.metrics import (evaluate_multi, evaluate_multi_models, evaluate_rowwise, evaluate_rowwise_models,
                                      simulated_metrics, simulated_models)
from quarry.operators.retrieve import best_hits, stacked_pass, top_k
from quarry.plans.pipelines import leaderboard

MODELS = 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    dims = [3, 5, 8]

    def side(name, n):
        rows = [(i, *[[float(x) for x in rng.integers(-3, 4, d)] for d in dims]) for i in range(n)]
        return spark.createDataFrame(rows, f"{name} bigint, " + ", ".join(f"e{i} array<double>" for i in range(MODELS))).checkpoint()

    rows = [(i, int(rng.integers(0, 25)), int(rng.integers(0, 60)), float(rng.integers(0, 2))) for i in range(300)]
    return spark.createDataFrame(rows, "row_id bigint, query_id bigint, ctx_id bigint, relevance double"), side("query_id", 25), side("ctx_id", 60)


def _one(df, i):
    return df.select(df.columns[0], F.col(f"e{i}").alias("embedding"))


@pytest.mark.parametrize("similarity", ["cosine", "dot"])
@pytest.mark.parametrize("query_bytes", [1 << 26, 6000, 0])      # one slice, several, blocks
def test_stacked_hits_are_each_models_hits(data, similarity, query_bytes):
    _, q, c = data
    got = best_hits(stacked_pass(q, c, MODELS, 5, similarity, query_bytes=query_bytes), 5, ("model", "query_id")).collect()
    for i in range(MODELS):
        want = top_k(_one(q, i), _one(c, i), 5, similarity).collect()
        assert sorted((r.query_id, r["rank"], r.ctx_id, r.score) for r in got if r.model == i) == sorted(
            (r.query_id, r["rank"], r.ctx_id, r.score) for r in want)


def test_metrics_of_all_models_at_once(data):
    rows, q, c = data
    hits = best_hits(stacked_pass(q, c, MODELS, 5), 5, ("model", "query_id"))
    near = lambda a, b: all(abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))
    wise = {r.model: tuple(r)[1:] for r in evaluate_rowwise_models(rows, hits, MODELS).collect()}
    multi = {r.model: tuple(r)[1:] for r in evaluate_multi_models(rows, q, c, MODELS, "dot").collect()}
    for i in range(MODELS):
        assert near(wise[i], tuple(evaluate_rowwise(rows, _one(q, i), _one(c, i)).first()))
        assert near(multi[i], tuple(evaluate_multi(rows, _one(q, i), _one(c, i), "dot").first()))


def test_simulated_models_are_each_models_rows(spark):
    pairs = spark.createDataFrame([(i, i % 4 == 0, 0.1 * i, 0.5) for i in range(9)], "row_id bigint, context_empty boolean, s0 double, s1 double")
    both = sorted(map(tuple, simulated_models(pairs, ["a", "b"]).collect()))
    each = [simulated_metrics(pairs.withColumnRenamed(s, "similarity"), m) for s, m in (("s0", "a"), ("s1", "b"))]
    assert both == sorted(tuple(r) for e in each for r in e.collect())


def _exchanges(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    tree = buf.getvalue().split("\n\n\n")[0]
    return tree.count("Exchange"), tree.count("MapInArrow")


def test_exchanges_do_not_grow_with_the_models(data):
    rows, q, c = data
    hits = lambda n: best_hits(stacked_pass(q, c, n, 5), 5, ("model", "query_id"))
    assert _exchanges(hits(1)) == _exchanges(hits(MODELS))
    assert _exchanges(evaluate_rowwise_models(rows, hits(1), 1)) == _exchanges(evaluate_rowwise_models(rows, hits(MODELS), MODELS))
    assert _exchanges(evaluate_multi_models(rows, q, c, 1)) == _exchanges(evaluate_multi_models(rows, q, c, MODELS))


def test_leaderboard_stages_as_many_tables_for_any_number_of_models(spark, monkeypatch):
    from quarry import session
    rows = spark.createDataFrame([(i, f"word{i % 5} query", f"word{i} context {i % 3}", float(i % 2)) for i in range(40)],
                                 "row_id bigint, query string, context string, relevance double")
    counts = []
    for n in (1, 4):
        before = len(session._STAGED)
        board = leaderboard(rows, {f"m{i}": HashEncoder(8 + i, i) for i in range(n)}, ("a query",))["board"]
        assert [r.model for r in board.orderBy("model_pos").collect()] == [f"m{i}" for i in range(n)]
        counts.append(len(session._STAGED) - before)
    assert counts[0] == counts[1]
