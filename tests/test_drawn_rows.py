"""Rows and the texts they draw: each text is moved once, to the row's place; the source is parsed once."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import training as T
from quarry.operators.skew import heavy_counts, heavy_hitters
from quarry.plans import pipelines as P

ROWS = "row_id bigint, query string, context string, relevance double"
TEXTS = {"context", "text", "_neg", "negatives", "positive", "_t0"}


def _moved_texts(df) -> int:
    """Exchanges of the plan that carry a text."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    inputs = re.findall(r"\n\(\d+\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", buf.getvalue())
    return sum(bool({c.split("#")[0].strip() for c in cols.split(",")} & TEXTS) for cols in inputs)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"Find a Horror prompt {i}", f"<Horror> </Horror> prompt dragons castle story{i}", float(i % 3 > 0)) for i in range(60)]
    return spark.createDataFrame(data, ROWS).repartition(3)


def test_training_examples_move_a_drawn_text_once(rows):
    assert _moved_texts(T.training_examples(rows)) == 1


def test_training_labelled_moves_a_drawn_text_once(rows):
    assert _moved_texts(T.training_labelled(rows)) == 1


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_hot_repeated_and_keyless_rows_keep_their_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "BROADCAST_ROWS", limit)
    data = [(i if i % 11 else None, f"q{i}", "the hot text" if i % 2 else f"text {i % 40}", 1.0) for i in range(200)]
    data += data[:30] + [(7, "other query", "the hot text", 1.0), (500, "null text", None, 1.0)]
    rows = spark.createDataFrame(data, ROWS).repartition(5)
    contexts = T.distinct_contexts(rows)
    text = {r.ctx_id: r.context for r in contexts.collect()}
    out = T.sample_negatives(rows, contexts, 3, "strict", 42).collect()
    assert sorted(map(repr, ((r.row_id, r.query, r.context, r.relevance) for r in out))) == sorted(map(repr, data))
    seen = {}
    for r in out:
        if r.row_id is None:
            assert r.negatives is None and r.neg_ids is None and r.pos_ctx_id is None
            continue
        assert text[r.pos_ctx_id] == r.context and [text[i] for i in r.neg_ids] == r.negatives
        assert len(set(r.neg_ids)) == 3 and r.pos_ctx_id not in r.neg_ids
        assert seen.setdefault((r.row_id, r.context), r.negatives) == r.negatives


def test_one_drawn_text_and_none(spark):
    rows = spark.createDataFrame([(1, "q", "a", 1.0), (2, "q", "b", 1.0)], ROWS)
    contexts = T.distinct_contexts(rows)
    one = {r.row_id: r.negatives for r in T.sample_negatives(rows, contexts, 1, "strict").collect()}
    assert one == {1: ["b"], 2: ["a"]}
    assert {tuple(r.negatives) for r in T.sample_negatives(rows, contexts, 0, "capped").collect()} == {()}


def test_counted_heavy_keys_are_those_of_the_sketch(spark):
    df = spark.createDataFrame([("a",)] * 30 + [("b",)] * 10 + [(f"x{i}",) for i in range(60)] + [(None,)] * 5, "k string")
    got, want = heavy_counts(df, "k", 0.08), heavy_hitters(df, "k", 0.08)
    assert got.keys == want.keys == [("a", 30), ("b", 10)] and got.total == want.total == 100


def test_the_training_set_parses_its_positives_once(rows, monkeypatch):
    calls = []
    real = T.add_alternative_queries
    monkeypatch.setattr(T, "add_alternative_queries", lambda *a, **k: calls.append(1) or real(*a, **k))
    made = P.build_training_set(rows, generated_at="2026-01-01 00:00:00")
    keys = sorted((r.row_id, r.aug_pos) for r in made["tuples"].select("row_id", "aug_pos").collect())
    assert sorted((r.row_id, r.aug_pos) for r in made["batches"].filter("epoch = 1").collect()) == keys
    assert made["manifest"].first()["training_examples"] == len(keys) and len(calls) == 1


def test_example_hits_are_sent_to_the_texts(spark, rows, monkeypatch):
    from quarry.operators.encode import HashEncoder
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = P.leaderboard(rows, {"a": HashEncoder(16, 1)}, ("dragons", "castle"))["examples"]
        assert _moved_texts(made) == 0 and made.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_csv_files_are_numbered_without_parsing_them(spark, tmp_path, monkeypatch):
    from quarry.sources import evalset_io as S
    plans, real = [], S.dense_index
    monkeypatch.setattr(S, "dense_index", lambda df, *a, **k: plans.append(df._jdf.queryExecution().toString()) or real(df, *a, **k))
    path = str(tmp_path / "an eval set % é")
    data = [(f"q{i}", f"line one\nline two {i}", 1.0) for i in range(20)]
    S.write_eval_csv(spark.createDataFrame(data, "query string, context string, relevance double").coalesce(1), path)
    got = S.read_eval_csv(spark, path, row_ids=True).orderBy("row_id").collect()
    assert [(r.query, r.context, r.relevance) for r in got] == data and len({r.row_id for r in got}) == 20
    assert "csv" not in plans[0].lower().split("binaryfile")[0]


def test_numbered_csv_rows_stay_where_they_are_read(spark, tmp_path):
    """The numbers of the files are sent to the rows: a join by file moved every row with its texts."""
    from quarry.sources import evalset_io as S
    path = str(tmp_path / "csv")
    data = [(i, f"q{i}", None if i % 9 == 4 else "" if i % 9 == 5 else f'text, "{i // 3}"\nline two', float(i % 2)) for i in range(90)]
    rows = spark.createDataFrame(data[::-1], ROWS).repartition(4)
    S.write_eval_csv(S.in_order(rows, "row_id"), path, compression="gzip")
    back = S.read_eval_csv(spark, path, row_ids=True)
    assert _moved_texts(back) == 0
    assert [tuple(r)[1:] for r in back.orderBy("row_id").collect()] == [r[1:] for r in data]
    files = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-")]
    assert files and all(p.suffix == ".gz" for p in files)
