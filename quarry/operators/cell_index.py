"""Exact top-k with a cell index (E3, E6): cells of near vectors that a bound skips.

The index is a table of the corpus sorted by cell, with each cell's centroid and
radius. Centroids come from Lloyd rounds run by Spark over a hashed sample of at most
FIT_ROWS vectors a cell; every vector is indexed. For a query ``q`` and a cell with centroid ``m`` and radius ``r``
(largest distance of a member) no member's dot product is above ``q.m + |q| r``
(Cauchy-Schwarz); for cosine all vectors are scaled to length 1, and by the triangle
inequality of angles no member is nearer than the angle between ``q`` and ``m`` less the
radius' angle. A search first scores each query's PROBES best
cells, which gives a score that k contexts reach, then those of the other cells whose
bound is not below it. Everything else cannot be in the result, so the result is that of
:func:`quarry.operators.retrieve.top_k`: same scores, same order among ties.

The corpus is scanned where it lies, and only in the cells some query needs; queries are
broadcast in slices of a checked size. What the driver holds is the cells' centroids
(at most MAX_CELLS) and one slice of queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.rand import hash_order
from quarry.operators.retrieve import PASS_SCHEMA, QUERY_BYTES, _QUERY_ROWS, BlockScorer, _norms, _vectors, best_hits
from quarry.session import stage_counted, stage_table

MAX_CELLS = 4096
FIT_ROWS = 256
ROUNDS = 6
PROBES = 2
INDEX_SCHEMA = "ctx_id bigint, embedding array<double>, cell int, dist double"
_CELLS_AT_ONCE = 1 << 20      # query x cell products held at once


def _scaled(m: np.ndarray, cosine: bool) -> np.ndarray:
    if not cosine or not m.size:
        return m
    n = _norms(m)
    return m / np.where(n > 0, n, 1.0)[:, None]


def _nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the first of equals) and the distance to it."""
    cell, dist = np.zeros(len(m), dtype=np.int64), np.zeros(len(m))
    step = max(1, _CELLS_AT_ONCE // max(1, len(centroids)))
    half = (centroids ** 2).sum(axis=1) / 2
    for i in range(0, len(m), step):
        part = m[i:i + step]
        cell[i:i + step] = np.argmin(half[None, :] - part @ centroids.T, axis=1)
        dist[i:i + step] = np.sqrt(((part - centroids[cell[i:i + step]]) ** 2).sum(axis=1))
    return cell, dist


def fit_centroids(corpus: DataFrame, cells: int, cosine: bool, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``corpus`` (``ctx_id, embedding``) by Lloyd rounds over a sample."""
    n = corpus.count() if cells > 1 else 1
    keyed = corpus.select("embedding", F.xxhash64(F.lit(seed), "ctx_id").alias("h"))
    share = min(1.0, FIT_ROWS * cells / max(1, n))
    if share < 1:
        keyed = keyed.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = stage_table(keyed, "cell-sample")
    first = sample.orderBy(hash_order(seed, "cell", F.col("h")), "h").limit(cells).select("embedding").toArrow()
    if first.num_rows == 0:
        return np.zeros((0, 0))
    centroids = np.unique(_scaled(_vectors(first["embedding"]), cosine), axis=0)
    for _ in range(rounds if len(centroids) > 1 else 0):
        shared = corpus.sparkSession.sparkContext.broadcast(centroids)

        def add_up(batches, shared=shared):
            at = shared.value
            sums, count = np.zeros_like(at), np.zeros(len(at), dtype=np.int64)
            for batch in batches:
                m = _scaled(_vectors(batch.column(0)), cosine)
                if len(m):
                    cell, _ = _nearest(m, at)
                    np.add.at(sums, cell, m)
                    count += np.bincount(cell, minlength=len(at))
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), pa.array(list(sums[seen]), pa.list_(pa.float64()))],
                                             names=["cell", "n", "sums"])

        parts = sample.select("embedding").mapInArrow(add_up, "cell bigint, n bigint, sums array<double>")
        # a row a task and cell
        total = F.aggregate(F.collect_list("sums"), F.array_repeat(F.lit(0.0), centroids.shape[1]),
                            lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        moved = parts.groupBy("cell").agg(F.sum("n").alias("n"), total.alias("sums")).toArrow()   # a row a cell
        means = _vectors(moved["sums"]) / moved["n"].to_numpy()[:, None]
        centroids = centroids.copy()
        centroids[moved["cell"].to_numpy()] = _scaled(means, cosine)
    return centroids


@dataclass
class CellIndex:
    table: DataFrame          # INDEX_SCHEMA, sorted by cell within its files
    centroids: np.ndarray
    radius: np.ndarray        # -1: an empty cell
    cosine: bool
    rows: int


def build_index(corpus: DataFrame, similarity: str = "cosine", cells: int | None = None, seed: int = 42) -> CellIndex:
    """Index ``corpus`` (``ctx_id, embedding``; read twice: hand in a written table)."""
    if similarity not in ("cosine", "dot"):
        raise ValueError("similarity must be 'cosine' or 'dot'")
    cosine = similarity == "cosine"
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(corpus.count())))
    centroids = fit_centroids(corpus, cells, cosine, seed)
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            m = _vectors(batch.column(1))
            if len(m):
                cell, dist = _nearest(_scaled(m, cosine), shared.value)
                if cosine:            # vectors without a direction: their cell is never skipped
                    dist[_norms(m) == 0] = 2.0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64())),
                                                  pa.array(cell.astype(np.int32)), pa.array(dist)],
                                                 names=["ctx_id", "embedding", "cell", "dist"])

    placed = corpus.select(F.col("ctx_id").cast("bigint").alias("ctx_id"), "embedding").mapInArrow(assign, INDEX_SCHEMA)
    # a cell of any size is spread: rows go by (cell, id), so a large cell fills several files
    table, rows = stage_counted(placed.repartitionByRange("cell", "ctx_id").sortWithinPartitions("cell", "ctx_id"), "cell-index")
    radius = np.full(len(centroids), -1.0)
    for r in table.groupBy("cell").agg(F.max("dist").alias("r")).collect():                       # a row a cell
        radius[r["cell"]] = r["r"]
    if cosine and len(centroids):
        radius[(_norms(centroids) == 0) & (radius >= 0)] = 2.0
    return CellIndex(table, centroids, radius, cosine, rows)


def _bounds(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """What members of each cell can score at most (-inf: empty), and how far rounding may be off."""
    dots, norm = q @ centroids.T, _norms(q)
    if cosine:
        reach = 2 * np.arcsin(np.clip(radius / 2, 0, 1))
        top = np.cos(np.maximum(np.arccos(np.clip(dots, -1, 1)) - reach[None, :], 0))
        slack = np.full(len(q), 1e-6)          # of arc functions near 0 and 180 degrees
    else:
        top = dots + norm[:, None] * np.maximum(radius, 0)[None, :]
        size = norm * (_norms(centroids).max(initial=0) + radius.max(initial=0) + 1)
        slack = 64.0 * (q.shape[1] + 8) * np.finfo(float).eps * size
    return np.where(radius[None, :] >= 0, top, -np.inf), slack


def _groups(batch: pa.RecordBatch):
    """Runs of one cell in a batch: ``cell, ids, vectors``."""
    cell = batch.column(0).to_numpy()
    ids, m = batch.column(1).to_numpy(), _vectors(batch.column(2))
    cuts = np.flatnonzero(np.diff(cell)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(cell)]]), strict=True):
        if b > a:
            yield int(cell[a]), ids[a:b], m[a:b]


def _slices(queries: DataFrame, bytes_a_row: int, query_bytes: int) -> list[DataFrame]:
    n = max(1, -(-queries.count() * bytes_a_row // query_bytes))
    return [queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _needs(queries: DataFrame, index: CellIndex, k: int, probes: int) -> DataFrame:
    """``query_id, q_vec, thr, probed, cells, n`` of queries with ``query_id, q_vec, thr``: the cells a query
    probes first, and (with a threshold) the others it needs, a bit a cell, and how many both are."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.cosine))

    def need(batches):
        centroids, radius, cosine = shared.value
        step = max(1, _CELLS_AT_ONCE // max(1, len(centroids)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                q = _scaled(_vectors(batch.column(1)), cosine)
                thr = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                top, slack = _bounds(q, centroids, radius, cosine)
                order = np.argsort(-(q @ centroids.T + np.where(radius >= 0, 0, -np.inf)[None, :]), axis=1,
                                   kind="stable")[:, :probes]
                first = np.zeros(top.shape, dtype=bool)
                np.put_along_axis(first, order, True, axis=1)
                least = np.where(np.isnan(thr), -np.inf, thr - slack)
                rest = (top >= least[:, None]) & (radius >= 0)[None, :] & ~first
                n = order.shape[1] + rest.sum(axis=1)
                bits = [pa.array([r.tobytes() for r in np.packbits(m, axis=1)], pa.binary()) for m in (first, rest)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *bits, pa.array(n.astype(np.int64))],
                                                 names=["query_id", "q_vec", "thr", "probed", "cells", "n"])

    return queries.select("query_id", "q_vec", "thr").mapInArrow(
        need, "query_id bigint, q_vec array<double>, thr double, probed binary, cells binary, n bigint")


def _bits(column, cells: int) -> np.ndarray:
    """A bit table of ``_needs``, a row for each eight cells: what one cell is asked by lies together."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return np.ascontiguousarray(rows.reshape(len(column), -(-cells // 8)).T)


def _scan(index: CellIndex, wanted: DataFrame, column: str, k: int) -> DataFrame:
    """Local candidates of the queries of ``wanted`` in the cells of its bit column."""
    spark, n_cells = wanted.sparkSession, len(index.centroids)
    side = wanted.select("query_id", "q_vec", "thr", column).toArrow()
    bits = _bits(side[column], n_cells)
    asked = np.unpackbits(np.bitwise_or.reduce(bits, axis=1), count=n_cells) if side.num_rows else np.zeros(0)
    cells = [int(c) for c in np.flatnonzero(asked)]                                               # at most MAX_CELLS
    if not cells:
        return spark.createDataFrame([], PASS_SCHEMA)
    shared = spark.sparkContext.broadcast((side["query_id"].to_numpy(), _vectors(side["q_vec"]), side["thr"].to_numpy(), bits))
    cosine = index.cosine

    def scan(batches):
        ids, q, thr, bits = shared.value
        for batch in batches:
            for c, ctx, m in _groups(batch):
                every = np.flatnonzero(bits[c >> 3] & (128 >> (c & 7)))
                for i in range(0, len(every), _QUERY_ROWS):          # no copy of all the queries of a cell
                    rows = every[i:i + _QUERY_ROWS]
                    scorer = BlockScorer(ids[rows], q[rows], k, cosine)
                    scorer.kth = np.where(np.isnan(thr[rows]), -np.inf, thr[rows])   # nothing below it can matter
                    scorer.add(ctx, m)
                    found = scorer.table()
                    if found.num_rows:
                        yield from found.to_batches()

    return index.table.filter(F.col("cell").isin(cells)).select("cell", "ctx_id", "embedding").mapInArrow(scan, PASS_SCHEMA)


def pruned_top_k(queries: DataFrame, index: CellIndex, k: int = 5, probes: int = PROBES,
                 query_bytes: int = QUERY_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(hits, report)``: exact top-k of ``queries`` (``query_id, embedding``) as
    :func:`~quarry.operators.retrieve.top_k` gives it, and one row with ``queries, cells, pairs, scored_pairs,
    skipped_share``: how many of the query x cell pairs were not looked into."""
    spark = queries.sparkSession
    q = stage_table(queries.select(F.col("query_id").cast("bigint").alias("query_id"),
                                   F.col("embedding").cast("array<double>").alias("q_vec"),
                                   F.lit(None).cast("double").alias("thr")), "cell-queries")
    dim = index.centroids.shape[1]
    if not index.rows:
        none = spark.createDataFrame([], "query_id bigint, ctx_id bigint, score double, rank int")
        return none, spark.createDataFrame([(q.count(), 0, 0, 0, 0.0)], "queries bigint, cells bigint, pairs bigint, "
                                           "scored_pairs bigint, skipped_share double")
    hits, needs = [], []
    for part in _slices(q, 8 * (dim + 4) + len(index.centroids) // 8, query_bytes):
        probing = stage_table(_needs(part, index, k, probes), "cell-probes")
        found = stage_table(_scan(index, probing, "probed", k), "cell-found")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
        kth = found.select("query_id", "score", place.alias("_p")).filter(F.col("_p") == k).select("query_id", F.col("score").alias("thr"))
        bounded = part.drop("thr").join(kth, "query_id", "left").select("query_id", "q_vec", "thr")
        need = stage_table(_needs(bounded, index, k, probes), "cell-needs")
        hits.append(found.unionByName(_scan(index, need, "cells", k)))
        needs.append(need.select("n"))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    counts = needs[0]
    for n in needs[1:]:
        counts = counts.unionByName(n)
    cells = int((index.radius >= 0).sum())
    scored = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    pairs = (F.count(F.lit(1)) * cells).cast("bigint")
    report = counts.agg(F.count(F.lit(1)).alias("queries"), F.lit(cells).cast("bigint").alias("cells"), pairs.alias("pairs"),
                        scored.alias("scored_pairs"),
                        F.coalesce(1 - F.try_divide(scored, pairs), F.lit(0.0)).alias("skipped_share"))
    return best_hits(every, k), report
