"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of distinct 5-word shingles. Items are
partitioned by set size (powers of two); an item of q shingles is indexed by
its MinHash sketch of the q - ceil(t q) + 1 least hashes: a document that
contains at least t of the item must hold one of them (pigeonhole), however long the
document is. A document probes the partitions its own size allows with all its
shingles, and every candidate is verified by exact shingle containment in the
same task, so documents are scanned once per index block and never moved. The item
table is indexed in blocks of at most INDEX_ROWS shingles, which bounds what
is broadcast.

Defined results: null, empty and blank items match nothing; items of fewer
than 5 words are one shingle and match documents of just these words;
repeated items are separate items, a missing item_id stays missing; null, empty and blank documents contain nothing; rows that
repeat a doc_id are reported each; empty tables give no pairs; other columns
are ignored, or kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import shingle_sets, slices, words
from quarry.session import stage_table

K = 5
THRESHOLD = 0.75
INDEX_ROWS = 2_000_000
PAIRS = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``item_id, text`` -> ``item_id, row, hash``: the items' distinct shingles."""
    for batch in batches:
        for row, n, data, offsets in slices(batch.column(1)):
            h, first = shingle_sets(words(data, offsets, fold=True), K)
            at = np.repeat(np.arange(n), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n).take(pa.array(at)),
                                              batch.column(2).slice(row, n).take(pa.array(at)),
                                              pa.array(h.view(np.int64))], names=["item_id", "row", "hash"])


class Index:
    """Sketches of one block of items, by size partition."""

    def __init__(self, item: pa.Array, row: np.ndarray, hashes: np.ndarray, threshold: float):
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        self.first = np.concatenate([start, [len(row)]]).astype(np.int64)
        self.hashes, self.item = hashes, item.take(pa.array(order[start]))
        self.size = np.diff(self.first)
        self.need = np.ceil(threshold * self.size - 1e-9).astype(np.int64)
        part = np.floor(np.log2(np.maximum(self.size, 1))).astype(np.int64)
        self.parts = []
        for p in np.unique(part):
            members = np.flatnonzero(part == p)
            rows = [np.arange(self.first[i], self.first[i] + self.size[i] - self.need[i] + 1) for i in members]
            key, owner = hashes[np.concatenate(rows)], np.repeat(members, [len(r) for r in rows])
            order = np.argsort(key, kind="stable")
            self.parts.append((int(self.need[members].min()), key[order], owner[order]))

    def contained(self, doc_set: np.ndarray) -> Iterator[tuple[int, int]]:
        """``(item, shared)`` of the items of which enough lies in a document's set."""
        for least, key, owner in self.parts:
            if len(doc_set) < least:
                continue
            lo = np.searchsorted(key, doc_set, "left")
            hi = np.searchsorted(key, doc_set, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            found = np.unique(np.concatenate([owner[lo[i]:hi[i]] for i in hit]))
            for i in found:
                own = self.hashes[self.first[i]:self.first[i + 1]]
                at = np.minimum(np.searchsorted(doc_set, own), len(doc_set) - 1)
                shared = int((doc_set[at] == own).sum())
                if shared >= self.need[i]:
                    yield int(i), shared


def indexes(items: DataFrame, threshold: float = THRESHOLD) -> Iterator[Index]:
    """Index blocks of ``items`` (``item_id, text``)."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text",
                        F.monotonically_increasing_id().alias("row"))
    shingles = stage_table(rows.mapInArrow(item_rows, "item_id bigint, row bigint, hash bigint"), "dc-items")
    blocks = max(1, -(-shingles.count() // (INDEX_ROWS // 2)))      # half full on average
    for b in range(blocks):
        part = shingles.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        yield Index(part["item_id"].combine_chunks(), part["row"].to_numpy(), part["hash"].to_numpy().view(np.uint64), threshold)


def _probe(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        for batch in batches:
            for row, n, data, offsets in slices(batch.column(1)):
                h, first = shingle_sets(words(data, offsets, fold=True), K)
                out = [(d, i, s) for d in range(n) for i, s in idx.contained(h[first[d]:first[d + 1]])]
                i = np.array([o[1] for o in out], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n).take(pa.array([o[0] for o in out], pa.int64())),
                     idx.item.take(pa.array(i)), pa.array(idx.size[i]), pa.array([o[2] for o in out], pa.int64())],
                    names=["doc_id", "item_id", "n_item", "n_shared"])
    return run


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``doc_id, item_id, n_item, n_shared`` with n_shared >= threshold * n_item."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for index in indexes(items, threshold):
        found = rows.mapInArrow(_probe(docs.sparkSession.sparkContext.broadcast(index)), PAIRS)
        out = found if out is None else out.unionAll(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns, one scan per index block."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in indexes(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = []
                for _, n, data, offsets in slices(batch.column(at)):
                    h, first = shingle_sets(words(data, offsets, fold=True), K)
                    clean += [next(shared.value.contained(h[first[d]:first[d + 1]]), None) is None for d in range(n)]
                yield batch.filter(pa.array(clean, pa.bool_()))
        docs = docs.mapInArrow(run, schema)
    return docs
