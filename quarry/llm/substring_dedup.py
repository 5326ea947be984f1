"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference.

A window is W consecutive words; a word goes if a window over it also starts in
a document with a smaller doc_id. The reference index holds, for every text,
its factors: a window's anchor is the least K-gram hash inside it, neighbouring
windows with one anchor form a factor of W to 2W - K words, and factors with
equal words are one reference block, owned by its least doc_id. Parsing a
document greedily replaces each of its factors by the block it equals; factors of
a smaller owner are duplicate spans as a whole. Only where blocks share an
anchor but differ (the boundaries of a repeated passage) are windows checked one by one,
and only by the blocks' owners: equal windows have equal anchors, so
nothing is missed, and a passage in very many documents costs one index row
per factor and document.

Anchors that a fixed-size sample shows to be frequent take a way without a
task per anchor (partial aggregates, and joins with a row per block or window
that is broadcast if it is small and split by adaptive execution if not). Blocks are compared
by anchor and hash, windows by two independent 64-bit hashes.

Defined results: null, empty and blank texts have no words and keep the empty
text; fewer than W words are kept whole; rows without doc_id are kept whole
and are no reference; rows that repeat a doc_id are judged each by its own
text and never against each other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small
from quarry.llm.words import Words, grams, mix, slices, words
from quarry.session import stage_table

W, K = 13, 5
SAMPLE_DOCS, SAMPLE_HITS, FREQUENT_MAX = 4096, 4, 100_000
_U = np.uint64
FACTORS = "anchor bigint, block bigint, doc_id bigint, tag bigint, at bigint, hot boolean"
WINDOWS = "win bigint, win2 bigint, doc_id bigint, tag bigint, at bigint, hot boolean"
_rng = np.random.Generator(np.random.PCG64(77))
_STEP = _rng.integers(1, 2**62, 1, dtype=np.uint64)[0] * _U(2) + _U(1)
_SECOND = _rng.integers(1, 2**62, W, dtype=np.uint64) * _U(2) + _U(1)


def factors(w: Words) -> tuple[np.ndarray, ...]:
    """``(doc, first window, windows, anchor, block)`` of a slice's factors."""
    n = len(w.hash)
    empty = np.zeros(0, np.int64)
    if n < W:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    g, _ = grams(w, K)
    starts = n - W + 1
    span = np.lib.stride_tricks.sliding_window_view(g, W - K + 1)[:starts]
    at = np.arange(starts) + span.argmin(axis=1)
    inside = w.doc[W - 1:] == w.doc[:starts]
    s = np.flatnonzero(inside)
    if not len(s):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    a = at[s]
    edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
    lo = s[edge]
    count = np.diff(np.concatenate([edge, [len(s)]]))
    # the factor's words as one hash: word hashes by their place in it
    length = count + W - 1
    power = np.full(2 * W, _STEP, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    block = np.zeros(len(lo), dtype=np.uint64)
    for j in range(int(length.max())):
        on = length > j
        block[on] += w.hash[lo[on] + j] * power[j]
    return w.doc[lo], lo, count, g[a[edge]], mix(block + length.astype(np.uint64))


def packed(first: np.ndarray, length) -> np.ndarray:
    return (first << 16) | length


def second_hash(w: Words) -> np.ndarray:
    """Another hash of the W words from each word on, independent of ``grams``."""
    n = len(w.hash)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(W if n >= W else 0):
        out[:n - W + 1] += w.hash[j:n - W + 1 + j] * _SECOND[j]
    return mix(out)


def factor_rows(hot=None, hot_only: bool = False):
    """Rows ``doc_id, text, tag`` -> index rows; ``at`` packs first window and windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value if hot is not None else np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for row, n, data, offsets in slices(batch.column(1)):
                w = words(data, offsets, fold=False)
                doc, lo, count, anchor, block = factors(w)
                at = packed(lo - w.first[doc], count)
                is_hot = np.zeros(len(doc), bool)
                if len(known):
                    is_hot = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                keep = np.flatnonzero(is_hot) if hot_only else np.arange(len(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[keep].view(np.int64)), pa.array(block[keep].view(np.int64)),
                     ids.take(pa.array(doc[keep] + row)), batch.column(2).take(pa.array(doc[keep] + row)), pa.array(at[keep]),
                     pa.array(is_hot[keep])], names=["anchor", "block", "doc_id", "tag", "at", "hot"])
    return run


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, tag, ats`` (packed factors, negative if hot) -> their windows;
    ``at`` packs first word and W."""
    for batch in batches:
        ids, tags, lists = batch.column(0), batch.column(2), batch.column(3)
        for row, n, data, offsets in slices(batch.column(1)):
            w = words(data, offsets, fold=False)
            g, _ = grams(w, W)
            g2 = second_hash(w)
            at_word, doc, at, hot = [], [], [], []
            for i in range(n):
                a = np.array(lists[row + i].as_py(), dtype=np.int64)
                flag = a < 0
                a = np.where(flag, ~a, a)
                count = a & 0xFFFF
                first = np.repeat(a >> 16, count)
                first = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
                at_word.append(w.first[i] + first)
                doc.append(np.full(len(first), row + i))
                at.append(packed(first, W))
                hot.append(np.repeat(flag, count))
            at_word, doc = np.concatenate(at_word), pa.array(np.concatenate(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[at_word].view(np.int64)), pa.array(g2[at_word].view(np.int64)), ids.take(doc), tags.take(doc),
                 pa.array(np.concatenate(at)), pa.array(np.concatenate(hot))],
                names=["win", "win2", "doc_id", "tag", "at", "hot"])


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``doc_id, text, ats`` (packed spans in words, or null) -> ``doc_id, n_words,
    n_removed, kept``."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(2)
        for row, n, data, offsets in slices(batch.column(1)):
            w = words(data, offsets, fold=False)
            raw = data.tobytes()
            total, removed, kept = [], [], []
            for i in range(n):
                a, b = int(w.first[i]), int(w.first[i + 1])
                gone = np.zeros(b - a + 1, dtype=np.int64)
                spans = lists[row + i].as_py()
                if spans:
                    p = np.array(spans, dtype=np.int64)
                    lo, length = p >> 16, p & 0xFFFF
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, lo + length, -1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                total.append(b - a)
                removed.append(b - a - len(keep))
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, n), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors in several documents of a sample of about SAMPLE_DOCS (by id hash);
    at most FREQUENT_MAX, the most frequent."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count() // SAMPLE_DOCS))) == 0)
    rows = (sample.mapInArrow(factor_rows(), FACTORS).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= SAMPLE_HITS).orderBy(F.desc("n"), "anchor").limit(FREQUENT_MAX).toArrow())
    return np.sort(rows["anchor"].to_numpy().view(np.uint64))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``documents``."""
    # a text is known by doc_id and its own hash: rows of one doc_id stay apart
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    known = docs.filter(F.col("doc_id").isNotNull())
    hot = docs.sparkSession.sparkContext.broadcast(frequent_anchors(known))

    # blocks: equal factors; owner = least doc_id; mixed = their anchor has other blocks too
    block, anchor = Window.partitionBy("anchor", "block"), Window.partitionBy("anchor")
    cold = (known.mapInArrow(factor_rows(hot), FACTORS).filter(~F.col("hot")).drop("hot")
            .withColumn("mixed", F.min("block").over(anchor) != F.max("block").over(anchor))
            .withColumn("owner", F.min("doc_id").over(block)))
    rows = stage_table(known.mapInArrow(factor_rows(hot, hot_only=True), FACTORS), "rlz-hot")
    # a row a block, not a document: broadcast if they are few, so no task gets a frequent block's rows
    owners = stage_table(rows.groupBy("anchor", "block").agg(F.min("doc_id").alias("owner")), "rlz-owners")
    kinds = owners.groupBy("anchor").agg((F.min("block") != F.max("block")).alias("mixed"))
    # at most FREQUENT_MAX anchors are frequent
    frequent = rows.join(small(owners), ["anchor", "block"]).join(F.broadcast(kinds), "anchor")
    cols = ["doc_id", "tag", "at", "owner", "mixed"]
    parsed = cold.select(*cols, F.lit(False).alias("hot")).union(frequent.select(*cols, "hot"))
    parsed = stage_table(parsed.filter((F.col("owner") < F.col("doc_id")) | F.col("mixed"))
                         .select("doc_id", "tag", "at", "hot", (F.col("owner") < F.col("doc_id")).alias("gone")), "rlz-parsed")

    # owners of blocks with a shared anchor look their windows up one by one
    ats = F.when(F.col("hot"), F.bitwise_not("at")).otherwise(F.col("at"))
    asked = (parsed.filter(~F.col("gone")).groupBy(F.col("doc_id").alias("o_id"), F.col("tag").alias("o_tag"))
             .agg(F.collect_list(ats).alias("ats")))
    own = (F.col("doc_id") == F.col("o_id")) & (F.col("tag") == F.col("o_tag"))
    wins = known.join(asked.hint("merge"), own).select("doc_id", "text", "tag", "ats").mapInArrow(window_rows, WINDOWS)
    wins = stage_table(wins, "rlz-windows")
    few = wins.filter(~F.col("hot")).withColumn("least", F.min("doc_id").over(Window.partitionBy("win", "win2")))
    firsts = stage_table(wins.filter("hot").groupBy("win", "win2").agg(F.min("doc_id").alias("least")), "rlz-firsts")
    many = wins.filter("hot").join(small(firsts), ["win", "win2"])
    cols = ["doc_id", "tag", "at", "least"]
    repeats = few.select(*cols).union(many.select(*cols)).filter("least < doc_id")

    spans = (parsed.filter("gone").select("doc_id", "tag", (F.col("at") + (W - 1)).alias("at"))
             .union(repeats.select("doc_id", "tag", "at")).groupBy(F.col("doc_id").alias("o_id"), F.col("tag").alias("o_tag"))
             .agg(F.collect_list("at").alias("ats")))
    return (docs.join(spans, own, "left").select("doc_id", "text", "ats")
            .mapInArrow(cut_texts, "doc_id bigint, n_words bigint, n_removed bigint, kept string"))
