"""Toxicity by classifier chains.

The categories are label columns in a fixed order (here: low quality, then
toxic). Each category has a linear model over the text's distinct words plus
the log-odds of all earlier categories; in training those are out-of-fold
predictions, in scoring the fitted models' own, so a later model learns from
inputs as they will be. Training takes at most TRAIN_ROWS labelled rows, drawn
per combination of labels: a rare one is taken whole, the rest of the room goes
to the others, by id hash; one text a doc_id (the least hash), of it at most TRAIN_WORDS
distinct words (the least hashes), so what reaches the driver is bounded in bytes too. A model
has at most MAX_WORDS words, those that tell its category best. Scoring reads whole texts. Rows are weighted back within a class and the bias
is set back to the share of the class among all labels. The threshold is
counted over all labelled rows, each scored by models that did not see it: the
least prediction from which on PRECISION of the rows are toxic, or the one that
tells the classes apart best (chi square) if that is lower. Counting words and
scoring is done in tasks over whole texts.

Defined results: null, empty and blank texts have no words and get the
models' bias; labels that are null are no labels, nor are those of other documents; repeated ones
count by their maximum; without a positive or a negative label a category predicts its base rate
and rejects nothing, as do predictions that tell the classes apart by less than MIN_Z standard
deviations; a single positive is scored by the model that saw it; an empty table gives no rows;
other columns are ignored, or kept by ``drop_toxic``.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.words import mix, slices, words
from quarry.session import stage_table

TRAIN_ROWS = 8000
TRAIN_WORDS = 4096            # distinct words of a training row: those of the least hashes
FOLDS, MAX_WORDS, MIN_Z = 3, 4096, 5.0
STEPS, L2, PRECISION = 300, 2.0, 0.98
BINS = 256                    # of the scores over all labelled rows, per unit of log-odds


def bags(batch_text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(row, n, hashes, first)``: distinct folded words per text; a word is a run
    without blanks and ASCII punctuation."""
    for row, n, data, offsets in slices(batch_text):
        w = words(data, offsets, fold=True, split_punctuation=True)
        order = np.argsort(w.hash)
        order = order[np.argsort(w.doc[order], kind="stable")]
        doc, h = w.doc[order], w.hash[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield row, n, h[keep], np.searchsorted(doc[keep], np.arange(n + 1))


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, h, first in bags(batch.column(1)):
            kept = [np.sort(h[a:b])[:TRAIN_WORDS] for a, b in zip(first[:-1], first[1:], strict=True)]
            h = np.concatenate(kept)
            first = np.concatenate([[0], np.cumsum([len(k) for k in kept])])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), lists], names=["doc_id", "bag"])


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


class Linear:
    """Logistic regression over selected words and the earlier categories' log-odds. ``rate``:
    labelled rows that each row of the sample stands for; ``col``: the words' places in ``vocab``."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, vocab: np.ndarray, n: int, extra: np.ndarray, y: np.ndarray,
                 rate: np.ndarray):
        pos = int(y.sum())
        all_pos, all_neg = float(rate @ y), float(rate @ (1 - y))
        self.bias, self.words, self.weights = float(np.log((all_pos + 1) / (all_neg + 1))), vocab[:0], np.zeros(0)
        self.extra = np.zeros(extra.shape[1])
        if not 0 < pos < n:
            return
        # within a class as in the whole, and classes as in the sample
        share_of = np.where(y > 0, rate * pos / all_pos, rate * (n - pos) / all_neg)
        bias0 = float(np.log((pos + 1) / (n - pos + 1)))
        # words whose document frequency is higher in the category
        a = np.bincount(col, weights=(share_of * y)[doc], minlength=len(vocab))
        b = np.bincount(col, weights=share_of[doc], minlength=len(vocab)) - a
        share = (a + b) / n
        z = (a / pos - b / (n - pos)) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / pos + 1 / (n - pos)))
        # indicators of the category only: words of clean texts would let length outvote them
        chosen = np.argsort(-z, kind="stable")[:MAX_WORDS]
        chosen = np.sort(chosen[z[chosen] >= MIN_Z])
        place = np.full(len(vocab), -1)
        place[chosen] = np.arange(len(chosen))
        on = place[col] >= 0
        doc, col = doc[on], place[col[on]]
        w, e, bias = np.zeros(len(chosen)), np.zeros(extra.shape[1]), bias0
        sums = [np.zeros_like(w), np.zeros_like(e), 0.0]
        for _ in range(STEPS):                            # full-batch Adagrad
            s = np.bincount(doc, weights=w[col], minlength=n) + extra @ e + bias
            err = share_of * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
            grads = [np.bincount(col, weights=err[doc], minlength=len(w)) + L2 * w, extra.T @ err + L2 * e, err.sum()]
            sums = [q + g * g for q, g in zip(sums, grads, strict=True)]
            w, e, bias = (v - 0.3 * g / np.sqrt(q + 1e-9) for v, g, q in zip((w, e, bias), grads, sums, strict=True))
        self.words, self.weights, self.extra = vocab[chosen], w, e
        self.bias = float(bias) + self.bias - bias0       # the classes as in the whole

    def predict(self, h: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        s = np.full(n, self.bias)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            s = s + np.bincount(np.repeat(np.arange(n), np.diff(first))[hit], weights=self.weights[at[hit]], minlength=n)
        if extra.shape[1]:
            s = s + extra @ self.extra
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Chain:
    """Models in chain order and the last category's threshold."""

    def __init__(self, models: list[Linear], threshold: float):
        self.models, self.threshold = models, threshold

    def predict(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, 0))
        for m in self.models:
            out = np.column_stack([out, m.predict(h, first, _log_odds(out))])
        return out


def train(h: np.ndarray, first: np.ndarray, labels: np.ndarray, fold: np.ndarray,
          rate: np.ndarray) -> tuple[list[Linear], list[Chain]]:
    """``labels``: one 0/1 column per category, in chain order. The models over all rows,
    and per fold a chain that did not see its rows."""
    n, cats = labels.shape
    sizes = np.diff(first)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # the words are sorted once for all models, and held as places: half the bytes of hashes
    vocab, col = np.unique(h), np.empty(len(h), dtype=np.int32)
    for at in range(0, len(h), 1 << 18):
        col[at:at + (1 << 18)] = np.searchsorted(vocab, h[at:at + (1 << 18)])
    oof, models, without = np.zeros((n, 0)), [], [[] for _ in range(FOLDS)]
    for c in range(cats):
        y, extra, held = labels[:, c].astype(float), _log_odds(oof), np.zeros(n)
        for f in range(FOLDS):
            ins, outs = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            renumber = np.full(n, -1, dtype=np.int32)
            renumber[ins] = np.arange(len(ins))
            on = renumber[doc] >= 0
            m = Linear(renumber[doc[on]], col[on], vocab, len(ins), extra[ins], y[ins], rate[ins])
            without[f].append(m)
            if len(outs):
                part = np.concatenate([[0], np.cumsum(sizes[outs])])
                held[outs] = m.predict(vocab[np.concatenate([col[first[i]:first[i + 1]] for i in outs])], part, extra[outs])
        models.append(Linear(doc, col, vocab, n, extra, y, rate))
        oof = np.column_stack([oof, held])
    return models, [Chain(m, float("inf")) for m in without]


def threshold(top: np.ndarray, low: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """From bins of predictions in falling order (greatest and least prediction, toxic rows,
    rows): midway between the last bin taken and the next, infinite if none is."""
    if not 0 < hits.sum() < rows.sum():
        return float("inf")
    got, seen, pos, n = np.cumsum(hits), np.cumsum(rows), hits.sum(), rows.sum()
    good = np.flatnonzero(got >= PRECISION * seen)
    lift = np.maximum(got * n - pos * seen, 0.0)
    chi = lift * lift * n / np.maximum(pos * (n - pos) * seen * (n - seen), 1e-9)   # 0 for all rows
    chi[-1] = 0
    best = np.flatnonzero(chi == chi.max())[-1:] if chi.max() >= MIN_Z ** 2 else good[:0]
    if not len(good) and not len(best):
        return float("inf")
    last = int(max([*good[-1:], *best]))
    return float((low[last] + top[last + 1]) / 2) if last + 1 < len(low) else float(low[last])


def quotas(counts: dict, room: int) -> dict:
    """Rows to take of each class: small ones whole, the others share what is left."""
    out = {}
    for i, (k, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[k] = min(n, room // (len(counts) - i))
        room -= out[k]
    return out


def _release() -> None:
    """Give the memory that Arrow and numpy have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Train on at most TRAIN_ROWS labelled rows (least id hashes of each combination of
    labels), set the threshold on all."""
    spark = docs.sparkSession
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").alias("l_id")).agg((F.max("quality") == 0).cast("int").alias("low"),
                                                        F.max("toxic").cast("int").alias("toxic")))
    known = stage_table(known.join(docs.select(F.col("doc_id").alias("d_id")), F.col("l_id") == F.col("d_id"), "left_semi"),
                        "tx-labels")
    counts = {(r["low"], r["toxic"]): r["n"] for r in known.groupBy("low", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not any(t > 0 for _, t in counts) or all(t > 0 for _, t in counts):
        none = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0)
        return Chain(train(*none)[0], float("inf"))
    take = quotas(counts, TRAIN_ROWS)
    # twice the quota by hash first, so that the window's tasks are bounded too
    room = spark.createDataFrame([(*k, q, counts[k] / max(1, q), 2.0 * q / counts[k] if 4 * q < counts[k] else 1.0)
                                  for k, q in take.items()],
                                 "r_low int, r_toxic int, quota int, rate double, part double")
    order = F.shiftrightunsigned(F.xxhash64("l_id"), 1)
    of_class = Window.partitionBy("low", "toxic").orderBy(order, "l_id")
    rows = (known.join(F.broadcast(room), (F.col("low") == F.col("r_low")) & (F.col("toxic") == F.col("r_toxic")))
            .filter(order / float(1 << 63) <= F.col("part"))
            .withColumn("pos", F.row_number().over(of_class)).filter("pos <= quota"))
    # folds in turn, so that each holds its part of the toxic rows
    turn = Window.partitionBy("toxic").orderBy("low", F.xxhash64(F.lit("fold"), "l_id"), "l_id")
    rows = stage_table(rows.withColumn("fold", F.row_number().over(turn) % FOLDS)
                       .select("l_id", "low", "toxic", "rate", "fold"), "tx-sample")
    bagged = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("l_id"))   # <= TRAIN_ROWS rows
    # one text a doc_id, so that the sample is bounded however often ids repeat
    sample = (bagged.select("doc_id", "text").mapInArrow(_bag_rows, "doc_id bigint, bag array<bigint>")
              .groupBy("doc_id").agg(F.min_by("bag", F.xxhash64("bag")).alias("bag"))
              .join(F.broadcast(rows), F.col("doc_id") == F.col("l_id"))
              .select("l_id", "bag", "low", "toxic", "rate", "fold").toArrow().sort_by("l_id"))
    bag = sample["bag"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(bag), dtype=np.int64))])
    h = (np.array(bag.flatten()) if len(bag) else np.zeros(0, np.int64)).view(np.uint64)
    y = np.column_stack([np.array(sample["low"], dtype=np.int64), np.array(sample["toxic"], dtype=np.int64)])
    fold, ids = np.array(sample["fold"], dtype=np.int64), np.array(sample["l_id"], dtype=np.int64)
    rate = np.array(sample["rate"], dtype=float)
    del sample, bag
    _release()                        # the driver keeps one copy of the words while it trains
    models, without = train(h, first, y, fold, rate)
    del h
    _release()
    if sum(n for (_, t), n in counts.items() if t) == 1:
        without = [Chain(models, float("inf"))] * FOLDS
    held = _held_out(docs, without, ids, fold)
    bins = (held.join(known, F.col("doc_id") == F.col("l_id")).groupBy("bin")
            .agg(F.max("p").alias("top"), F.min("p").alias("low"), F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("bin")).collect())               # at most 60 * BINS + 1 rows
    cols = [np.array([r[c] for r in bins], dtype=float) for c in ("top", "low", "hits", "rows")]
    return Chain(models, threshold(*cols))


def _held_out(docs: DataFrame, without: list[Chain], ids: np.ndarray, fold: np.ndarray) -> DataFrame:
    """``doc_id, bin, p``: each row's prediction by a chain that was not trained on it."""
    shared = docs.sparkSession.sparkContext.broadcast((without, ids, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, seen, folds = shared.value
        for batch in batches:
            for row, n, h, first in bags(batch.column(1)):
                own = batch.column(0).slice(row, n)
                d = own.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.minimum(np.searchsorted(seen, d), len(seen) - 1)
                f = np.where(seen[at] == d, folds[at], (mix(d.view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64))
                p = np.stack([c.predict(h, first)[:, -1] for c in chains])[f, np.arange(n)]
                q = np.clip(p, 1e-13, 1 - 1e-13)
                place = np.floor(np.log(q / (1 - q)) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([own, pa.array(place), pa.array(p)], names=["doc_id", "bin", "p"])
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, bin bigint, p double")


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id, p_low_quality, p_toxic, toxic`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, h, first in bags(batch.column(1)):
                p = shared.value.predict(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(p[:, 0]), pa.array(p[:, 1]),
                     pa.array(p[:, 1] >= shared.value.threshold)], names=["doc_id", "p_low_quality", "p_toxic", "toxic"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, p_low_quality double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` below the threshold; all columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [shared.value.predict(h, first)[:, -1] < shared.value.threshold
                     for _, _, h, first in bags(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))
    return docs.mapInArrow(run, docs.schema)
