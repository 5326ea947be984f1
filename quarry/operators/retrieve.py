"""Exact vector retrieval without a cross join.

One pass over the corpus scores it against the queries and keeps, per query, the
k best contexts and (where a threshold is given) the number of contexts ordered
before it. Two routes, same rows:

* a query side of a checked size (``QUERY_BYTES``) is broadcast and the corpus
  is scanned where it lies, up to ``QUERY_SLICES`` such slices one scan each: no exchange of the corpus;
* beyond them queries and corpus are cut into hash blocks of up to ``BLOCK_BYTES``; query
  block ``qb`` meets corpus block ``cb`` in one cogroup group, a task of its own. Data moved:
  every query row once per corpus block and every corpus row once per query block, never the
  pairs, and ``k`` hits a query and corpus block: the fewer and larger the blocks the less, so
  they are as large as a task's memory allows.

Inside a task numpy scores chunk by chunk (at most ``query rows x chunk`` scores
held). A window over the local candidates then gives the global top-k (Catalyst
plans it as a WindowGroupLimit).

Ordering is total: score descending, then ``ctx_id`` ascending. Cosine of a
zero vector is 0.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BYTES = 64 << 20   # largest query side (vectors and kept hits) that is broadcast at once
QUERY_SLICES = 16        # most slices of queries, each with a scan of the corpus of its own
BLOCK_BYTES = 128 << 20  # vectors (and kept hits) of a block of either side that a task holds
MOST_TASKS = 100_000     # partitions of the block pairs; beyond them a task takes several pairs, one after another
FED_ROWS = 16384         # corpus rows of a block that are scored at once
PASS_SCHEMA = "query_id bigint, ctx_id bigint, score double, n_before bigint"
STACKED_SCHEMA = PASS_SCHEMA + ", model int"
_SCORE_CELLS = 1 << 20   # at most ~1M float32 scores (4 MB, what a core's cache holds) per chunk
_QUERY_ROWS = 1024       # query rows scored at once
_PAIR_CELLS = 1 << 20    # vector cells gathered at once by the pair kernel
_PICKED = 1 << 19        # pairs picked out of a chunk at once
_EXACT = float(1 << 24)  # whole numbers up to here are exact in float32


def _chunk(n_query_rows: int) -> int:
    """Corpus columns scored at once, so query rows x chunk stays bounded
    whatever ``query_block_rows`` is set to."""
    return max(256, min(8192, _SCORE_CELLS // max(1, n_query_rows)))


def _matrix(values) -> np.ndarray:
    if len(values) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _pair_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise dot product in doubles, summed dimension by dimension: the result depends
    only on the two rows, never on their place in a block."""
    out = np.zeros(len(x))
    for j in range(x.shape[1] if x.ndim == 2 else 0):
        out += np.multiply(x[:, j], y[:, j], dtype=np.float64)
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_pair_dot(m, m)) if m.size else np.zeros(len(m))


def _pair_scores(q, qn, c, cn, rows, cols, cosine: bool) -> np.ndarray:
    """The scores that decide: pairs (rows[i], cols[i]) by the one pair kernel."""
    out = np.zeros(len(rows))
    step = max(1, _PAIR_CELLS // max(1, q.shape[1]))
    for i in range(0, len(rows), step):
        r, k = rows[i:i + step], cols[i:i + step]
        s = _pair_dot(q[r], c[k])
        if cosine:
            den = qn[r] * cn[k]
            s = np.where(den > 0, s / np.where(den > 0, den, 1.0), 0.0)
        out[i:i + step] = s
    return out


def _top(m: np.ndarray, axis: int | None = None):
    """Largest finite absolute value (0 if there is none)."""
    a = np.abs(m)
    return np.max(a, axis=axis, initial=0.0, where=np.isfinite(a))


def _whole(m: np.ndarray) -> bool:
    return bool(np.isfinite(m).all() and (m == np.rint(m)).all())


def _size(norm, unit, d: int):
    """Length of vectors divided by ``unit``, their largest value; the most it can be if the norm tells nothing."""
    return np.where(np.isfinite(norm) & (norm > 0), np.minimum(norm / unit, math.sqrt(max(1, d))), math.sqrt(max(1, d)))


def _below(x: np.ndarray) -> np.ndarray:
    """``x`` as float32, rounded down."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _per_row(mask: np.ndarray) -> np.ndarray:
    """Set cells a row, counted eight at a time."""
    return np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)


def _picked(mask: np.ndarray):
    """``rows, cols`` of the set cells, a bounded number at once (of a row all at once)."""
    if np.count_nonzero(mask) <= _PICKED:
        yield np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))
        return
    step = max(1, _PICKED // max(1, mask.shape[1]))
    for r in range(0, len(mask), step):
        rows, cols = np.divmod(np.flatnonzero(mask[r:r + step]), mask.shape[1])
        yield rows + r, cols


def _vectors(col, keep: bool = False) -> np.ndarray:
    """An Arrow list column as a matrix of doubles, from its flat buffer; ``keep``: floats stay floats."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(arr) == 0:
        return np.zeros((0, 0))
    sizes = pc.min_max(pc.list_value_length(arr)).as_py()
    if arr.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("embeddings must be present and of one dimension")
    m = arr.flatten().to_numpy(zero_copy_only=False)
    return (m if keep and m.dtype == np.float32 else m.astype(np.float64)).reshape(len(arr), -1)


class BlockScorer:
    """A block of queries and what it keeps of the contexts it is fed: per query the
    ``k`` best, and the number ordered before its threshold ``(thr, thr_ctx)`` (NaN:
    none wanted). A float32 matrix product of scaled vectors only sorts out what is clearly
    in or out (its error is bounded); order and ties are decided by the pair kernel, which also made
    the thresholds. Dot products of whole numbers small enough to be exact decide by themselves.
    Once a query holds k contexts, only what reaches the k-th of them is looked at."""

    def __init__(self, ids, vecs, k: int, cosine: bool, thr=None, thr_ctx=None):
        self.ids, self.vecs, self.k, self.cosine = np.asarray(ids, dtype=np.int64), vecs, k, cosine
        self.norms = _norms(vecs)
        self.ranked = thr is not None
        self.thr = np.asarray(thr, dtype=np.float64) if self.ranked else None
        self.thr_ctx = np.asarray(thr_ctx, dtype=np.int64) if self.ranked else None
        n = len(self.ids)
        self.before = np.zeros(n, dtype=np.int64)
        self.kth = np.full(n, -np.inf)
        self.held = np.zeros(n, dtype=np.int64)
        self.best_ids, self.best_scores = np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        self.whole = not cosine and _whole(vecs)
        if cosine:
            self.scale = np.ones(n)
            unit = np.where(self.norms > 0, self.norms, 1.0)
        else:
            self.scale = unit = _top(vecs, axis=1) if vecs.size else np.zeros(n)
            self.scale = unit = np.where(unit > 0, unit, 1.0)
        self.flat = vecs if self.whole and vecs.dtype == np.float32 else np.zeros(vecs.shape, dtype=np.float32)
        for q0 in range(0, n if vecs.size else 0, _QUERY_ROWS):     # no second matrix of doubles
            qs = slice(q0, q0 + _QUERY_ROWS)
            if self.flat is not vecs:
                self.flat[qs] = vecs[qs] if self.whole else vecs[qs] / unit[qs, None]

    def add(self, cids: np.ndarray, cm: np.ndarray) -> None:
        if len(cids) == 0:
            return
        cn = _norms(cm)
        d = self.vecs.shape[1] if self.vecs.size else 0
        exact = self.whole and bool(max(1.0, cn.max()) * self.norms.max(initial=1.0) < _EXACT) and _whole(cm)
        if exact:
            flat, by = cm.astype(np.float32, copy=False), 1.0
        elif self.cosine:
            flat, by = (cm / np.where(cn > 0, cn, 1.0)[:, None]).astype(np.float32), 1.0
        else:
            by = float(_top(cm)) or 1.0
            flat = (cm / by).astype(np.float32)
        for q0 in range(0, len(self.ids), _QUERY_ROWS):
            qs = slice(q0, min(q0 + _QUERY_ROWS, len(self.ids)))
            q = self.flat[qs]
            if exact:
                slack, unit = np.zeros(len(q)), np.ones(len(q))
            else:
                if self.whole:          # whole numbers too large to be exact
                    q = (self.vecs[qs] / self.scale[qs, None]).astype(np.float32)
                # by Cauchy-Schwarz: two roundings to float32 and a sum of d products
                unit = self.scale[qs]
                size = 1.01 * (np.ones(len(q)) if self.cosine else _size(self.norms[qs], unit, d) * _size(cn.max(), by, d))
                slack = 2.0 * (d + 8) * np.finfo(np.float32).eps * size
            step = _chunk(len(q))
            for c0 in range(0, len(cids), step):
                cs = slice(c0, c0 + step)
                self._chunk(qs, q @ flat[cs].T, unit, by, slack, exact, cids[cs], cm[cs], cn[cs])

    def _scores(self, qs, s, exact, cm, cn, rows, cols) -> np.ndarray:
        if exact:
            return s[rows, cols].astype(np.float64)
        return _pair_scores(self.vecs[qs], self.norms[qs], cm, cn, rows, cols, self.cosine)

    def _chunk(self, qs, s, unit, by, slack, exact, cids, cm, cn) -> None:
        if self.ranked:
            thr, tid = self.thr[qs], self.thr_ctx[qs]
            at = thr / unit / by
            over, near = s > _above(at + slack)[:, None], s >= _below(at - slack)[:, None]
            near ^= over                        # what is over is near too
            self.before[qs] += _per_row(over)
            self._uncount_own(qs, over, near, tid, cids)
            for rows, cols in _picked(near):
                score, t = self._scores(qs, s, exact, cm, cn, rows, cols), thr[rows]
                before = (score > t) | ((score == t) & (cids[cols] < tid[rows]))
                self.before[qs] += np.bincount(rows[before], minlength=len(s))
        if self.k:
            floor = self.kth[qs] / unit / by - slack
            mask = s >= _below(floor)[:, None]
            crowd = np.flatnonzero(_per_row(mask) > 4 * self.k) if self.k < s.shape[1] else ()
            if len(crowd):
                kth = -np.partition(-s[crowd], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                floor[crowd] = np.fmax(floor[crowd], kth - 2 * slack[crowd])
                mask[crowd] = s[crowd] >= _below(floor[crowd])[:, None]
            for rows, cols in _picked(mask):
                if len(rows):
                    self._keep(qs, rows, cids[cols], self._scores(qs, s, exact, cm, cn, rows, cols))

    def _uncount_own(self, qs, over, near, tid, cids) -> None:
        """A query's threshold context is never counted: clear it in both masks."""
        order = np.argsort(cids, kind="stable")
        place = cids[order]
        lo, hi = np.searchsorted(place, tid), np.searchsorted(place, tid, "right")
        for row in np.flatnonzero(hi > lo):
            cols = order[lo[row]:hi[row]]
            self.before[qs.start + row] -= np.count_nonzero(over[row, cols])
            near[row, cols] = False

    def _keep(self, qs, rows, ids, score) -> None:
        """Merge found contexts into the k best of their queries; the other queries' are not touched."""
        touched = np.unique(rows)
        old, place = np.nonzero(np.arange(self.k)[None, :] < self.held[qs][touched][:, None])
        old = touched[old]
        rows = np.concatenate([old, rows])
        ids = np.concatenate([self.best_ids[qs.start + old, place], ids])
        score = np.concatenate([self.best_scores[qs.start + old, place], score])
        order = np.lexsort((ids, -score, rows))
        rows, ids, score = rows[order], ids[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        rows, ids, score, place = qs.start + rows[keep], ids[keep], score[keep], place[keep]
        self.best_ids[rows, place], self.best_scores[rows, place] = ids, score
        end = np.append(rows[1:] != rows[:-1], True)
        self.held[rows[end]] = place[end] + 1
        last = place == self.k - 1
        self.kth[rows[last]] = score[last]

    def table(self) -> pa.Table:
        """Rows of PASS_SCHEMA: a hit has ``ctx_id, score``, a count ``n_before``."""
        rows, place = np.nonzero(np.arange(self.k)[None, :] < self.held[:, None])
        ids, score = self.best_ids[rows, place], self.best_scores[rows, place]
        want = np.flatnonzero(~np.isnan(self.thr)) if self.ranked else np.zeros(0, dtype=np.int64)
        gap = lambda n, kind: pa.nulls(n, kind)
        return pa.table({
            "query_id": pa.concat_arrays([pa.array(self.ids[rows]), pa.array(self.ids[want])]),
            "ctx_id": pa.concat_arrays([pa.array(ids), gap(len(want), pa.int64())]),
            "score": pa.concat_arrays([pa.array(score), gap(len(want), pa.float64())]),
            "n_before": pa.concat_arrays([gap(len(rows), pa.int64()), pa.array(self.before[want])])})


def plan_blocks(n_queries: int, n_corpus: int, parallelism: int,
                query_block_rows: int = 4096, corpus_block_rows: int = 16384) -> tuple[int, int]:
    """Numbers of query blocks QB and corpus blocks CB.

    Rows moved are ``n_queries*CB + n_corpus*QB``; at least ``4*parallelism``
    block pairs keep every core busy, and the block-row limits bound a
    group's memory. Minimising the moved rows under QB*CB >= G gives
    QB ~ sqrt(G*Q/C), CB ~ sqrt(G*C/Q); both are then raised to their limits."""
    if n_queries <= 0 or n_corpus <= 0:
        return 1, 1
    groups = 4 * max(1, parallelism)
    qb_min = math.ceil(n_queries / query_block_rows)
    cb_min = math.ceil(n_corpus / corpus_block_rows)
    qb = max(qb_min, round(math.sqrt(groups * n_queries / n_corpus)), 1)
    cb = max(cb_min, math.ceil(groups / qb), 1)
    qb = min(qb, n_queries)
    cb = min(cb, n_corpus)
    return qb, cb


def _row_bytes(df: DataFrame, vecs: list[str], dims: list[int], others: int) -> int:
    """Bytes of a row's vectors as they are held, and of ``others``."""
    width = lambda v: 4 if df.schema[v].dataType.elementType.simpleString() == "float" else 8
    return sum(width(v) * d for v, d in zip(vecs, dims, strict=True)) + others


def _blocked(q: DataFrame, c: DataFrame, qb: int, cb: int):
    """``q`` and ``c`` dealt to their block pairs: the pair ``qb, cb`` is partition ``qb * CB + cb`` (modulo
    their number), so that no two meet in one task; a hash of the pair would put several into some."""
    parts = min(qb * cb, MOST_TASKS)
    q = (q.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)))
         .withColumn("_cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cb - 1).cast("bigint")))))
    c = (c.withColumn("_cb", F.pmod(F.xxhash64("ctx_id", F.lit(7)), F.lit(cb)))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qb - 1).cast("bigint")))))
    # Scoring is CPU-bound numpy: an explicit number of partitions (AQE keeps user-given counts; it
    # would otherwise coalesce this small-by-bytes shuffle onto a few cores)
    q, c = (x.withColumn("pair", (F.col("_qb") * F.lit(cb) + F.col("_cb")).cast("int")).drop("_qb", "_cb")
             .repartitionById(parts, "pair") for x in (q, c))
    return q.groupBy("pair").cogroup(c.groupBy("pair"))


def stacked_pass(queries: DataFrame, corpus: DataFrame, models: int, k: int, similarity: str = "cosine",
                 n_corpus: int | None = None,
                 query_block_rows: int | None = None, corpus_block_rows: int | None = None,
                 query_bytes: int = QUERY_BYTES) -> DataFrame:
    """One scoring pass for all models: rows of PASS_SCHEMA with the ``model`` (0, 1, ...).

    ``queries``: ``query_id, e0, e1, ...`` (a vector per model) and, where counts are
    wanted, ``thr0, ctx0, thr1, ...``; ``corpus``: ``ctx_id, e0, e1, ...``. A query without a
    threshold (null) gets no count. Each model's vectors are scored on their own inside the
    task, so the plan is the same for any number of models. The query side is read
    twice (its size is checked before it may be broadcast): hand in a written table. Blocks hold
    ``query_block_rows`` and ``corpus_block_rows``, by default what ``BLOCK_BYTES`` hold."""
    if similarity not in ("cosine", "dot"):
        raise ValueError("similarity must be 'cosine' or 'dot'")
    cosine = similarity == "cosine"
    spark = queries.sparkSession
    vecs = [f"e{i}" for i in range(models)]
    limits = [c for i in range(models) for c in (f"thr{i}", f"ctx{i}") if f"thr{i}" in queries.columns]
    q = queries.select(F.col("query_id").cast("bigint").alias("query_id"), *vecs, *limits)
    c = corpus.select(F.col("ctx_id").cast("bigint").alias("ctx_id"), *vecs)
    size = q.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.size(v)).alias(v) for v in vecs]).first()
    each = [size[v] or 0 for v in vecs]
    dims, held = sum(each), 32 * models * (k + 1)

    def scorers(t: pa.Table) -> list[BlockScorer]:
        ids = t["query_id"].to_numpy()
        out = []
        for i, v in enumerate(vecs):
            thr = t[f"thr{i}"].to_numpy() if f"thr{i}" in t.column_names else None
            ctx = pc.fill_null(t[f"ctx{i}"], 0).to_numpy() if thr is not None else None
            out.append(BlockScorer(ids, _vectors(t[v], keep=True), k, cosine, thr, ctx))
        return out

    def result(made: list[BlockScorer]) -> pa.Table:
        parts = [s.table() for s in made]
        return pa.concat_tables([p.append_column("model", pa.array(np.full(p.num_rows, i, dtype=np.int32)))
                                 for i, p in enumerate(parts)])

    def scanned(part: DataFrame) -> DataFrame:
        side = spark.sparkContext.broadcast(part.toArrow())

        def scan(batches):
            made = scorers(side.value)
            for batch in batches:
                for i, s in enumerate(made):
                    s.add(batch.column(0).to_numpy(), _vectors(batch.column(1 + i), keep=True))
            yield from result(made).to_batches()

        return c.mapInArrow(scan, STACKED_SCHEMA)

    slices = math.ceil(size["n"] * (8 * dims + held) / query_bytes) if query_bytes > 0 else QUERY_SLICES + 1
    if slices <= QUERY_SLICES:
        part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, slices)))
        scans = [scanned(q.filter(part == i) if slices > 1 else q) for i in range(max(1, slices))]
        return reduce(DataFrame.union, scans)
    nc = corpus.count() if n_corpus is None else n_corpus
    qb, cb = plan_blocks(size["n"], nc, spark.sparkContext.defaultParallelism,
                         query_block_rows or max(1, BLOCK_BYTES // _row_bytes(q, vecs, each, held)),
                         corpus_block_rows or max(1, BLOCK_BYTES // _row_bytes(c, vecs, each, 8)))

    def meet(qt: pa.Table, ct: pa.Table) -> pa.Table:
        made = scorers(qt)
        for batch in ct.to_batches(max_chunksize=FED_ROWS):     # the block is not held twice
            ids = batch.column("ctx_id").to_numpy()
            for v, s in zip(vecs, made, strict=True):
                s.add(ids, _vectors(batch.column(v), keep=True))
        return result(made)

    return _blocked(q, c, qb, cb).applyInArrow(meet, STACKED_SCHEMA)


def score_pass(queries: DataFrame, corpus: DataFrame, k: int, similarity: str = "cosine",
               n_corpus: int | None = None,
               query_block_rows: int | None = None, corpus_block_rows: int | None = None,
               query_bytes: int = QUERY_BYTES) -> DataFrame:
    """:func:`stacked_pass` of one model: ``query_id, embedding`` and, if ``queries`` has
    them, ``thr_score, thr_ctx`` -> rows of PASS_SCHEMA."""
    names = {"embedding": "e0", "thr_score": "thr0", "thr_ctx": "ctx0"}
    q = queries.select("query_id", *[F.col(c).alias(n) for c, n in names.items() if c in queries.columns])
    c = corpus.select("ctx_id", F.col("embedding").alias("e0"))
    return stacked_pass(q, c, 1, k, similarity, n_corpus, query_block_rows, corpus_block_rows, query_bytes).drop("model")


def best_hits(passed: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Global top-k of a scoring pass: ``query_id, ctx_id, score, rank``; of a stacked one with
    ``by=("model", "query_id")`` with the model in front."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("ctx_id").asc())
    return (passed.filter(F.col("ctx_id").isNotNull()).select(*by, "ctx_id", "score")
                  .withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= k))


def counted_ranks(passed: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Full-depth ranks of a scoring pass: ``by, rank``."""
    return (passed.filter(F.col("n_before").isNotNull())
                  .groupBy(*by).agg((F.sum("n_before") + 1).alias("rank")))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, similarity: str = "cosine",
          n_corpus: int | None = None,
          query_block_rows: int | None = None, corpus_block_rows: int | None = None,
          query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Top-k contexts per query: ``query_id, ctx_id, score, rank`` (rank 1..k).

    ``queries``: ``query_id, embedding``; ``corpus``: ``ctx_id, embedding``
    (ids unique; embeddings array<float|double> of one dimension)."""
    return best_hits(score_pass(queries.select("query_id", "embedding"), corpus, k, similarity,
                                n_corpus, query_block_rows, corpus_block_rows, query_bytes), k)


def rank_before(queries: DataFrame, corpus: DataFrame, similarity: str = "cosine",
                n_corpus: int | None = None,
                query_block_rows: int | None = None, corpus_block_rows: int | None = None,
                key: str = "query_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Full-depth rank of a given context per query without sorting all pairs.

    ``queries``: ``<key>, embedding, thr_score, thr_ctx`` (key unique) ->
    ``<key>, rank`` where rank = 1 + #contexts ordered before
    (thr_score desc, thr_ctx asc); the context ``thr_ctx`` itself is never
    counted."""
    q = queries.select(F.col(key).alias("query_id"), "embedding", "thr_score", "thr_ctx")
    passed = score_pass(q, corpus, 0, similarity, n_corpus, query_block_rows,
                        corpus_block_rows, query_bytes)
    return counted_ranks(passed).withColumnRenamed("query_id", key)


def pair_similarity(a, b, similarity: str = "cosine"):
    """Column: similarity of two vector columns row by row (Arrow-batched
    numpy). A missing vector gives 0.0."""
    from pyspark.sql.functions import pandas_udf

    cosine = similarity == "cosine"

    @pandas_udf("double")
    def _sim(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        ok = np.array([u is not None and v is not None and len(u) == len(v) and len(u) > 0
                       for u, v in zip(x.values, y.values)], dtype=bool)
        if ok.any():
            xm = _matrix(x.values[ok])
            ym = _matrix(y.values[ok])
            dot = _pair_dot(xm, ym)
            if cosine:
                den = _norms(xm) * _norms(ym)
                with np.errstate(divide="ignore", invalid="ignore"):
                    dot = np.where(den > 0, dot / np.where(den > 0, den, 1.0), 0.0)
            out[ok] = dot
        return pd.Series(out)

    return _sim(a, b)
