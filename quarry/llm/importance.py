"""Importance resampling towards a target distribution with Arrow kernels.

Texts become hashed n-gram features: ``ascii_lower``, ``split_pattern_regex`` and
``list_flatten`` give the words, ``dictionary_encode`` their numbers, shifted
numbers the n-grams; only distinct n-grams are spelled out and hashed (CRC-32 modulo the
number of buckets). One pass counts the buckets of the corpus and of the target
texts (summed per task before the shuffle; the counts are as many as buckets),
a second one sums up each document's gains. The draw is a seeded Gumbel top-k: scores are
ranked by range partitions, so the drawn part may be of any size.

Only batches of bounded size are in memory (a single longer text is its own batch).

Defined results: null and empty texts have no features, weight 0 and are not drawn if
``min_words`` is above 0; repeated rows are rows like others; a missing doc_id counts
as an empty one in the seed and comes first among equal scores, rows of equal score and
doc_id go by weight and features; an empty target or corpus has only the pseudo-counts;
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_slices
from quarry.operators.ids import dense_index
from quarry.session import stage_table

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # what is no digit, letter or non-ASCII character
BATCH_BYTES = 2 << 20
FEATURE_SCHEMA = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def gram_buckets(texts: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, bucket, n_words)``: the features of a batch with their documents, and the
    words of each document."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    solid = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(solid).dictionary_encode()
    doc = doc.filter(solid).to_numpy(zero_copy_only=False).astype(np.int64)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = coded.dictionary
    n_words = np.bincount(doc, minlength=len(texts))
    docs, found = [doc], [_hashed(spelled, buckets)[word] if len(word) else word]
    gram, grams = word, spelled
    for n in range(2, max_n + 1):
        if len(word) < n:
            break
        inside = doc[n - 1:] == doc[:len(doc) - n + 1]
        pair = gram[:len(word) - n + 1] * len(spelled) + word[n - 1:]
        distinct, at = np.unique(pair[inside], return_inverse=True)
        grams = pc.binary_join_element_wise(grams.take(pa.array(distinct // len(spelled))),
                                            spelled.take(pa.array(distinct % len(spelled))),
                                            pa.scalar(" ", spelled.type))
        docs.append(doc[:len(doc) - n + 1][inside])
        found.append(_hashed(grams, buckets)[at])
        gram = np.zeros(len(inside), dtype=np.int64)      # pairs across documents are never taken up again
        gram[inside] = at
    return np.concatenate(docs), np.concatenate(found), n_words


def _hashed(grams: pa.Array, buckets: int) -> np.ndarray:
    raw = grams.cast(pa.large_binary()).to_pylist()
    return np.fromiter((zlib.crc32(g) % buckets for g in raw), dtype=np.int64, count=len(raw))


def bucket_counts(docs: DataFrame, max_n: int, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in all texts."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0), BATCH_BYTES):
                total += np.bincount(gram_buckets(texts, max_n, buckets)[1], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.collect():                              # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored, scaled log ratio of the buckets' smoothed shares in target and corpus."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` per row: the floored mean gain of its features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        table = shared.value
        for batch in batches:
            for row, texts in text_slices(batch.column(1), BATCH_BYTES):
                doc, bucket, n_words = gram_buckets(texts, max_n, len(table))
                order = np.argsort(doc, kind="stable") if max_n > 1 else slice(None)
                doc, won = doc[order], table[bucket[order]]
                n = np.bincount(doc, minlength=len(texts))
                sums = np.diff(np.concatenate([[0], np.cumsum(won)])[np.concatenate([[0], np.cumsum(n)])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(n_words.astype(np.int64)),
                     pa.array(n.astype(np.int64)), pa.array(sums // np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(weigh, FEATURE_SCHEMA)


def gumbel(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """Floored, scaled Gumbel noise of a document."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1,
             buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``target`` has
    ``text``. ``percent`` of the rows of at least ``min_words`` words are drawn: ranks 1, 2, 3 ...
    by score; other rows have none."""
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    scored = stage_table(weights(docs, gain, max_n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)),
                         "importance")
    able = F.col("n_words") >= min_words
    # a row's own number keeps a third of equal rows from falling into one range
    order = scored.filter(able).withColumns({"_down": -F.col("score"), "_tie": F.monotonically_increasing_id()})
    placed, n = dense_index(order, ["_down", "doc_id", "weight", "n_features", "_tie"], out="_at", with_total=True)
    rank = F.when(F.col("_at") < F.lit(percent * n // 100), F.col("_at") + 1)
    cols = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*cols, rank.cast("bigint").alias("rank")).unionByName(
        scored.filter(~able).select(*cols, F.lit(None).cast("bigint").alias("rank")))
