"""The hash encoder reads a batch's hashes where they lie."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.operators.encode import _bucket_udf


def test_a_batch_is_counted_in_parts(spark):
    hashes = np.random.default_rng(0).integers(0, 1 << 60, 2_000_000)
    batch = pa.ListArray.from_arrays(pa.array(np.arange(0, 2_000_001, 200, dtype=np.int32)), pa.array(hashes))
    tracemalloc.start()
    try:
        out = _bucket_udf(64).func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 << 20
    first = np.bincount(hashes[:200] % 64, weights=np.where((hashes[:200] >> 40) & 1, -1.0, 1.0), minlength=64)
    assert out[0].as_py() == first.tolist() and len(out) == 10000


def test_missing_and_empty_lists_and_slices(spark):
    batch = pa.array([[7], None, [], [1 << 40, 3, 3]], pa.list_(pa.int64()))
    got = _bucket_udf(4).func(batch).to_pylist()
    assert got == [[0, 0, 0, 1], [0] * 4, [0] * 4, [-1, 0, 0, 2]]
    assert _bucket_udf(4).func(batch.slice(2)).to_pylist() == got[2:]


def test_tokens_are_hashed_once_each():
    from quarry.operators.encode import _token_hash, _token_hashes
    flat = pa.array(["b", "a", "b", "é", "a"]).slice(1)
    assert _token_hashes(3, flat).tolist() == [_token_hash(3, t) for t in ("a", "b", "é", "a")]
    assert _token_hashes(3, flat.slice(0, 0)).tolist() == []


def test_lists_of_tokens_give_the_counts_of_their_hashes(spark):
    from quarry.operators.encode import HashEncoder, hash_vectors
    texts = ["a b, b", "", "Ä_c 1", "a"] * 300
    want = hash_vectors(texts, 8, 5).tolist()
    rows = spark.createDataFrame(list(enumerate(texts)) + [(9999, None)], "i int, t string").coalesce(1)
    got = rows.select("i", HashEncoder(8, 5)("t").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [*want, [0] * 8]
    batch = pa.array([["a", "b", "b"], None, [], ["1"]], pa.list_(pa.string()))
    assert _bucket_udf(8, 5).func(batch).to_pylist() == hash_vectors(["a b b", "", "", "1"], 8, 5).tolist()
