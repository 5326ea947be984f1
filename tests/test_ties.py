"""Exact ties, rows that must not be lost, and the CSV hand-off."""

import json

import numpy as np
import pandas as pd
import pytest

from quarry.operators import retrieve as R
from quarry.operators.compare import improvement, model_means
from quarry.operators.encode import HashEncoder, embed_all, index_texts, pandas_encoder
from quarry.operators.keys import distinct_texts
from quarry.operators.training import distinct_contexts, sample_negatives
from quarry.plans import pipelines as P
from quarry.sources.evalset_io import read_eval_csv, write_eval_csv
from quarry.sources.reports import comparison_json


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("cosine", [True, False])
def test_blocks_decide_ties_like_the_pair_kernel(dim, cosine):
    rng = np.random.default_rng(dim)
    ctx = rng.normal(size=(400, dim))
    ctx[150:270] = ctx[3]                                  # 120 equal vectors
    qs = rng.normal(size=(60, dim))
    qn, cn = R._norms(qs), R._norms(ctx)
    rows, cols = np.divmod(np.arange(60 * 400), 400)
    exact = R._pair_scores(qs, qn, ctx, cn, rows, cols, cosine).reshape(60, 400)
    for parts in (1, 3):                                   # independent of the blocking
        whole = R.BlockScorer(range(60), qs, 5, cosine, exact[:, 200], np.full(60, 200))
        apart = [R.BlockScorer(range(60), qs, 5, cosine, exact[:, 200], np.full(60, 200)) for _ in range(parts)]
        for i in range(parts):
            ids, vecs = np.arange(400)[i::parts], ctx[i::parts]
            whole.add(ids, vecs)
            apart[i].add(ids, vecs)
        rows = pd.concat([x.table().to_pandas() for x in apart])
        for got in (whole.table().to_pandas(), rows):
            before, hits = got.groupby("query_id")["n_before"].sum(), got[got.ctx_id.notna()]
            for i in range(60):
                order = sorted(range(400), key=lambda j: (-exact[i, j], j))
                assert before[i] == order.index(200)
                mine = hits[hits.query_id == i].sort_values(["score", "ctx_id"], ascending=[False, True])
                assert mine.ctx_id.tolist()[:5] == order[:5]


def _rows(spark, shift=0):
    data = [(1, "Find a red fox", "a red fox runs", 1.0), (2, "", "a blue cat sleeps", 1.0),
            (3, "Find a blue cat", None, 0.0), (4, None, "green tree", 0.0), (5, "Find a tree", "", 1.0)]
    return spark.createDataFrame([(i + shift, *r) for i, *r in data],
                                 "row_id bigint, query string, context string, relevance double")


def test_no_row_is_lost_and_ids_do_not_matter(spark):
    boards = []
    for shift in (0, -100):
        board = P.leaderboard(_rows(spark, shift), {"h": HashEncoder(32, 1)})["board"].drop("model")
        boards.append([tuple(r) for r in board.collect()])
        assert board.first()["n_rows"] == 5
    assert boards[0] == boards[1]


def test_csv_round_trip_feeds_the_leaderboard(spark, tmp_path):
    path = str(tmp_path / "eval")
    write_eval_csv(_rows(spark).repartition(1).sortWithinPartitions("row_id"), path)
    back = read_eval_csv(spark, path, row_ids=True)
    got = [(r["query"], r["context"], r["relevance"]) for r in back.orderBy("row_id").collect()]
    assert got == [(r["query"], r["context"], r["relevance"]) for r in _rows(spark).orderBy("row_id").collect()]
    assert P.leaderboard(back, {"h": HashEncoder(32, 1)})["board"].first()["n_rows"] == 5
    assert P.compare_models(back, HashEncoder(32, 1), HashEncoder(32, 2)).count() == 5


def test_repeated_keys_get_exactly_n_negatives(spark):
    rows = spark.createDataFrame([(7, "c0"), (7, "c1"), (7, "c1"), (8, "c2"), (9, "c3"), (10, "c4")],
                                 "row_id bigint, context string")
    out = sample_negatives(rows, distinct_contexts(rows), 3).collect()
    assert len(out) == 6
    for r in out:
        assert len(r["negatives"]) == 3 and len(set(r["negatives"])) == 3 and r["context"] not in r["negatives"]


def test_no_rows_report_zeros_and_names_are_escaped(spark):
    none = spark.createDataFrame([], "model string, metric string, metric_pos int, value double")
    means = model_means(none, ("a", "b"), ("x", "y"))
    impr = improvement(means, "a", "b")
    assert sorted((r["metric"], r["base"], r["relative"]) for r in impr.collect()) == [("x", 0.0, 0.0), ("y", 0.0, 0.0)]
    doc = comparison_json(impr, 'C:\\models\\"one"', "b", "2026-01-01").first()["json"]
    assert json.loads(doc)["base_model"] == 'C:\\models\\"one"'


def test_plugged_encoder_sees_each_distinct_text_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "c", "ab", "", None])],
                                 "row_id bigint, text string")
    index, total = index_texts(rows, "text", "ctx_id", with_total=True)
    assert total == 4
    lengths = pandas_encoder(lambda ts: np.array([[len(t), 1.0] for t in ts]), 2)
    one, two = embed_all(index, "ctx_id", [lengths, HashEncoder(8, 1)])
    got = {r["ctx_id"]: list(r["embedding"]) for r in one.collect()}
    assert got == {0: [2.0, 1.0], 1: [1.0, 1.0], 3: [0.0, 1.0], 4: [0.0, 1.0]}
    assert {r["ctx_id"] for r in two.collect()} == set(got)


def test_text_keys_keep_missing_and_empty_apart(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("",), (None,), ("a",), ("a",)], "t string")
    got = distinct_texts(rows, F.col("t"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r["text"], r["n"]) for r in got} == {("", 1), (None, 1), ("a", 2)}
    assert len({r["text_key"] for r in got}) == 3
