"""Tuples by reference: the tuples of training_examples, without a text in any exchange."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG
from quarry.operators.keys import text_key
from quarry.operators.training import TextStore, training_examples, training_refs, tuple_texts


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"Find a Horror prompt {i}", f"<Horror> </Horror> <T{i % 7}> </T{i % 7}> prompt dragons castle story{i % 23} é", float(i % 3 > 0))
            for i in range(90)]
    return spark.createDataFrame(data, "row_id bigint, query string, context string, relevance double").repartition(3)


@pytest.fixture(scope="module")
def refs(rows):
    return training_refs(rows, 3, DEFAULT_CONFIG)


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_references_name_the_texts_of_the_tuples(spark, rows, refs):
    tuples, texts = refs
    text = {r.text_key: r.text for r in texts.collect()}
    got = sorted((r.row_id, r.aug_pos, r.query, text[r.positive_key], [text[k] for k in r.negative_keys], r.label, r.augmented)
                 for r in tuples.collect())
    assert got == sorted(tuple(r) for r in training_examples(rows, 3, DEFAULT_CONFIG).collect())


def test_texts_are_looked_up_bucket_by_bucket(spark, rows, refs):
    tuples, texts = refs
    store = TextStore(texts, buckets=5)
    long = tuple_texts(tuples, store)
    want = {(r.row_id, s): t for r in training_examples(rows, 3, DEFAULT_CONFIG).filter("aug_pos = 0").collect()
            for s, t in enumerate([r.positive, *r.negatives])}
    assert {(r.row_id, r.slot): r.text for r in long.collect()} == want
    assert store.lookup(spark.createDataFrame([("no such key",)], "k string"), "k").count() == 0
    store.drop()


def test_no_exchange_carries_a_text(refs):
    tuples, texts = refs
    store = TextStore(texts, buckets=5)
    for df in (tuples, tuple_texts(tuples, store)):
        plan = _plan(df)
        exchanges = re.findall(r"\n\(\d+\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)
        assert exchanges
        for cols in exchanges:
            names = {c.split("#")[0].strip() for c in cols.split(",")}
            assert not names & {"context", "text", "_neg", "negatives", "positive"}, names
    plan = _plan(tuple_texts(tuples, store))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    store.drop()


def test_keys_are_of_the_text_alone(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "t string").select(text_key(F.col("t")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys[0] == keys[1] and len(keys[0]) == 32 and keys[3] == "" and keys[2] != ""
