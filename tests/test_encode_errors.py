"""Encoders that fail on single texts: the error stays with the text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.encode import (HashEncoder, IsolatingEncoder, embed_table, encode_errors, encode_isolated,
                                     hash_vectors)
from quarry.plans.pipelines import compare_paired

BAD = {"bad 3", "bad 500", "bad 501"}


def _fn(texts):
    if BAD & set(texts):
        raise ValueError(f"unreadable: {sorted(BAD & set(texts))}")
    return hash_vectors(texts, 16, 3)


def test_halving_finds_just_the_failing_texts():
    texts = [f"bad {i}" for i in range(1000)]
    calls = []
    m, errors = encode_isolated(lambda t: (calls.append(len(t)), _fn(t))[1], texts, 16)
    assert {t for t, e in zip(texts, errors) if e} == BAD
    good = [i for i, e in enumerate(errors) if not e]
    assert np.array_equal(m[good], hash_vectors([texts[i] for i in good], 16, 3))
    assert len(calls) <= 1 + 2 * 3 * 10


def test_no_failure_is_one_call():
    calls = []
    m, errors = encode_isolated(lambda t: (calls.append(1), hash_vectors(t, 4, 0))[1], ["a", "b"], 4)
    assert calls == [1] and errors == [None, None]
    assert encode_isolated(_fn, [], 16)[1] == []


def test_wrong_shapes_and_numbers_are_errors():
    assert all("shape" in e for e in encode_isolated(lambda t: np.zeros((len(t), 3)), ["a", "b"], 4)[1])
    m, errors = encode_isolated(lambda t: np.array([[np.nan if x == "b" else 1.0] * 2 for x in t]), ["a", "b", "c"], 2)
    assert [bool(e) for e in errors] == [False, True, False] and m[2].tolist() == [1, 1]


def test_python_and_native_hash_vectors_agree(spark):
    texts = ["The cat, the dog!", "é_x 日本 42", "", "A  b\tc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.v for r in df.select("id", HashEncoder(8, 5)(F.col("text")).alias("v")).collect()}
    assert [got[i] for i in range(4)] == hash_vectors(texts, 8, 5).tolist()


def test_error_columns_and_counts(spark):
    df = spark.createDataFrame([(i, f"bad {i}") for i in range(600)], "id int, text string").repartition(3)
    t = embed_table(df, "id", [HashEncoder(16, 3), IsolatingEncoder(_fn, 16)])
    rows = {r.id: r for r in t.collect()}
    assert {i for i, r in rows.items() if r.x1} == {3, 500, 501} == {i for i, r in rows.items() if r.e1 is None}
    assert all(r.e1 == r.e0 for r in rows.values() if not r.x1)
    assert [tuple(r) for r in encode_errors(t, ["n", "m"]).collect()] == [("m", "ValueError", 3)]
    assert encode_errors(t.drop("x1"), ["n", "m"]).count() == 0


def test_paired_comparison_with_a_failing_model(spark):
    rows = [(i, f"bad {i}", f"context {i}") for i in range(495, 505)] + [(3, "fine", "bad 3"), (4, "fine", ""), (5, "fine", None)]
    ts = spark.createDataFrame(rows, "entry_id long, query string, context string")
    ok = compare_paired(ts, HashEncoder(16, 3), HashEncoder(16, 3), order_cols=("entry_id",))
    r = compare_paired(ts, HashEncoder(16, 3), IsolatingEncoder(_fn, 16), order_cols=("entry_id",))
    want = {(p.model, p.row_id): p.similarity for p in ok["pairs"].collect()}
    got = {(p.model, p.row_id): (p.similarity, p.failed) for p in r["pairs"].collect()}
    failing = {("candidate", str(i)) for i in (500, 501, 3)}
    assert {k for k, v in got.items() if v[1]} == failing
    assert all(v == ((0.0, True) if k in failing else (want[k], False)) for k, v in got.items())
    assert sorted(tuple(e) for e in r["errors"].collect()) == [("candidate", "ValueError", 1, "context"), ("candidate", "ValueError", 2, "query")]
    assert r["per_row"].count() == len(rows) * 2 * 5


@pytest.mark.parametrize("n", [1, 2, 7])
def test_all_texts_failing(n):
    def no(texts):
        raise KeyError("x")
    m, errors = encode_isolated(no, ["t"] * n, 2)
    assert all(e.startswith("KeyError") for e in errors) and not m.any()
