"""Retrieval metrics.

Two families share metric names and must not be mixed up:

* row-judged (one own context per row): precision@k rewards a negative row
  (relevance != 1) when its context is *not* retrieved; MRR and nDCG use the
  own context's rank in the top 5 and give negative rows 0. nDCG's ideal is
  the constant 1, so nDCG@5 = 1/log2(rank+1).
* multi-relevant (judgement map): precision@k counts contexts judged 1.0 in
  the top k, MRR uses the full-depth rank of the best relevant context,
  nDCG@5 uses graded gains with the ideal from the top-5 judged gains. Means
  run over all rows, queries repeated in several rows count that often.

Means are computed from distinct (query, context, relevance) / query keys
weighted by their multiplicity, so a query text that fills a third of the
rows reaches the reducers pre-aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.functions.rand import hash_uniform
from quarry.operators.retrieve import best_hits, counted_ranks, pair_similarity, stacked_pass, top_k
from quarry.session import stage_table

METRICS = ("precision@1", "precision@3", "precision@5", "mrr", "ndcg@5")
METRIC_COLS = ("p_at_1", "p_at_3", "p_at_5", "mrr", "ndcg_at_5")


def own_rank(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rank of each row's own context among the hits (null if absent)."""
    h = hits.select("query_id", "ctx_id", F.col("rank").alias("own_rank"))
    return rows.join(h, ["query_id", "ctx_id"], "left")


def rowwise_columns(rank, relevance) -> list:
    """M1-M3 as Columns over the own rank (null = not in top 5)."""
    pos = relevance == F.lit(1.0)
    cols = []
    for k in (1, 3, 5):
        hit = F.coalesce(rank <= F.lit(k), F.lit(False))
        cols.append(F.when(pos, F.when(hit, F.lit(1.0 / k)).otherwise(F.lit(0.0)))
                     .otherwise(F.when(hit, F.lit(0.0)).otherwise(F.lit(1.0)))
                     .alias(f"p_at_{k}"))
    in5 = pos & F.coalesce(rank <= F.lit(5), F.lit(False))
    cols.append(F.when(in5, F.lit(1.0) / rank).otherwise(F.lit(0.0)).alias("mrr"))
    cols.append(F.when(in5, F.lit(1.0) / F.log2(rank + F.lit(1))).otherwise(F.lit(0.0))
                 .alias("ndcg_at_5"))
    return cols


def rowwise_metrics(rows: DataFrame, queries: DataFrame, corpus: DataFrame,
                    similarity: str = "cosine", hits: DataFrame | None = None) -> DataFrame:
    """Per row: ``row_id, own_rank, p_at_1, p_at_3, p_at_5, mrr, ndcg_at_5``.

    ``rows``: ``row_id, query_id, ctx_id, relevance``; ``queries`` /
    ``corpus``: vectors of the distinct query and context ids."""
    hits = hits if hits is not None else top_k(queries, corpus, 5, similarity)
    r = own_rank(rows, hits)
    return r.select("row_id", "own_rank", *rowwise_columns(F.col("own_rank"), F.col("relevance")))


def evaluate_rowwise(rows: DataFrame, queries: DataFrame, corpus: DataFrame,
                     similarity: str = "cosine", hits: DataFrame | None = None) -> DataFrame:
    """M4: one row of means. Rows are first collapsed to distinct
    (query, context, relevance) keys with a count (map-side combined)."""
    hits = hits if hits is not None else top_k(queries, corpus, 5, similarity)
    return evaluate_rowwise_models(rows, hits.withColumn("model", F.lit(0)), 1).drop("model")


def evaluate_rowwise_models(rows: DataFrame, hits: DataFrame, models: int) -> DataFrame:
    """M4 of all models in one pass: a row of means per ``model`` (0, 1, ...). ``hits``: top-5
    hits with their ``model``; the ranks of all models are columns of one join."""
    keys = rows.groupBy("query_id", "ctx_id", "relevance").agg(F.count(F.lit(1)).alias("_w"))
    wide = hits.groupBy("query_id", "ctx_id").agg(*[
        F.max(F.when(F.col("model") == i, F.col("rank"))).alias(f"_r{i}") for i in range(models)])
    r = keys.join(wide, ["query_id", "ctx_id"], "left")
    # rows are counted by relevance and rank and the few counts weighted in a fixed order: the
    # means are the same however the rows lie
    pos = F.coalesce(F.col("relevance") == F.lit(1.0), F.lit(False))
    cases = [(p, k) for p in (True, False) for k in (1, 2, 3, 4, 5, None)]
    at = lambda i, k: F.col(f"_r{i}") == k if k else F.coalesce(F.col(f"_r{i}") > 5, F.lit(True))
    counts = [F.coalesce(F.sum(F.when((pos == F.lit(p)) & at(i, k), F.col("_w"))), F.lit(0)).alias(f"_n{i}_{j}")
              for i in range(models) for j, (p, k) in enumerate(cases)]
    t = r.agg(*counts, F.sum("_w").alias("n_rows"))
    means = []
    for i in range(models):
        each = [rowwise_columns(F.lit(k).cast("int"), F.lit(1.0 if p else 0.0)) for p, k in cases]
        means += [F.coalesce(reduce(lambda a, b: a + b, [each[j][m] * F.col(f"_n{i}_{j}") for j in range(len(cases))])
                             / F.col("n_rows"), F.lit(0.0)).alias(f"{name}_{i}") for m, name in enumerate(METRIC_COLS)]
    return _model_rows(t.select(*means, "n_rows"), models)


def _model_rows(wide: DataFrame, models: int) -> DataFrame:
    """One row with the metric columns of all models -> a row per model."""
    return wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("model"), *[
        F.col(f"{c}_{i}").alias(c) for c in METRIC_COLS], F.col("n_rows")) for i in range(models)])))


def judgements(rows: DataFrame, order_col: str = "row_id") -> DataFrame:
    """``query_id, ctx_id, gain`` - one per pair, the last row wins."""
    return rows.groupBy("query_id", "ctx_id").agg(
        F.max_by("relevance", order_col).alias("gain"))


def judged_hits(hits: DataFrame, judg: DataFrame) -> DataFrame:
    """Hits with their judged gain, 0 when not judged."""
    return (hits.join(judg, ["query_id", "ctx_id"], "left")
                .withColumn("gain", F.coalesce(F.col("gain"), F.lit(0.0))))


def multi_query_metrics(rows: DataFrame, queries: DataFrame, corpus: DataFrame,
                        similarity: str = "cosine", hits: DataFrame | None = None,
                        n_corpus: int | None = None) -> DataFrame:
    """M5-M7 per distinct query: ``query_id, weight, p_at_1.., mrr, ndcg_at_5``.

    ``n_corpus`` (an upper bound suffices) only sizes the blocks."""
    return multi_query_metrics_models(
        rows, queries.select("query_id", F.col("embedding").alias("e0")),
        corpus.select("ctx_id", F.col("embedding").alias("e0")), 1, similarity,
        None if hits is None else hits.withColumn("model", F.lit(0)), n_corpus).drop("model")


def multi_query_metrics_models(rows: DataFrame, queries: DataFrame, corpus: DataFrame, models: int,
                               similarity: str = "cosine", hits: DataFrame | None = None,
                               n_corpus: int | None = None) -> DataFrame:
    """M5-M7 of all models in one pass, per ``model`` (0, 1, ...) and distinct query. ``queries`` /
    ``corpus``: an id and a vector per model (``e0, e1, ...``)."""
    by, vecs = ["model", "query_id"], [f"e{i}" for i in range(models)]
    judg = judgements(rows)
    rel1 = F.col("gain") == F.lit(1.0)
    # the best context judged 1.0 is the query's threshold; then one pass over the
    # corpus returns both the top five and the rank of that context
    rel = judg.filter(rel1).select("query_id", "ctx_id")
    qv = queries.select("query_id", *[F.col(v).alias(f"_q{v}") for v in vecs])
    cv = corpus.select("ctx_id", *[F.col(v).alias(f"_c{v}") for v in vecs])
    scored = rel.join(qv, "query_id").join(cv, "ctx_id").select("query_id", "ctx_id", *[
        pair_similarity(F.col(f"_q{v}"), F.col(f"_c{v}"), similarity).alias(f"_s{i}") for i, v in enumerate(vecs)])
    best = scored.groupBy("query_id").agg(*[
        F.min(F.struct((-F.col(f"_s{i}")).alias("ns"), F.col("ctx_id").alias("c"))).alias(f"_b{i}") for i in range(models)])
    thr = stage_table(queries.join(best, "query_id", "left").select("query_id", *vecs, *[
        c for i in range(models) for c in ((-F.col(f"_b{i}.ns")).alias(f"thr{i}"), F.col(f"_b{i}.c").alias(f"ctx{i}"))]),
        "thresholds")
    passed = stage_table(stacked_pass(thr, corpus, models, 0 if hits is not None else 5, similarity, n_corpus), "scored")
    ranks = counted_ranks(passed, tuple(by))
    hits = hits if hits is not None else best_hits(passed, 5, tuple(by))
    jh = judged_hits(hits, judg)
    disc = F.lit(1.0) / F.log2(F.col("rank") + F.lit(1))
    prec = jh.groupBy(*by).agg(
        *[(F.sum(F.when(rel1 & (F.col("rank") <= k), 1.0).otherwise(0.0)) / F.lit(float(k)))
          .alias(f"p_at_{k}") for k in (1, 3, 5)],
        F.sum(F.when(F.col("rank") <= 5, F.col("gain") * disc).otherwise(0.0)).alias("dcg"))
    # ideal: the five largest positive gains of the query (window limit is
    # applied map-side before the shuffle, so hot queries stay bounded)
    wi = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), F.col("ctx_id"))
    ideal = (judg.filter(F.col("gain") > 0)
                 .withColumn("_i", F.row_number().over(wi)).filter(F.col("_i") <= 5)
                 .groupBy("query_id")
                 .agg(F.sum(F.col("gain") / F.log2(F.col("_i") + F.lit(1))).alias("idcg")))
    weights = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("weight"))
    each = weights.join(ideal, "query_id", "left").withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(models)])))
    return (each.join(prec, by, "left").join(ranks, by, "left")
                .select(*by, "weight",
                        *[F.coalesce(F.col(f"p_at_{k}"), F.lit(0.0)).alias(f"p_at_{k}")
                          for k in (1, 3, 5)],
                        F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)).alias("mrr"),
                        F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"))
                         .otherwise(F.lit(0.0)).alias("ndcg_at_5")))


def evaluate_multi(rows: DataFrame, queries: DataFrame, corpus: DataFrame,
                   similarity: str = "dot", hits: DataFrame | None = None,
                   n_corpus: int | None = None) -> DataFrame:
    """M8: one row; each metric summed over all rows (by query weight) / rows."""
    return _weighted_means(multi_query_metrics(rows, queries, corpus, similarity, hits, n_corpus))


def evaluate_multi_models(rows: DataFrame, queries: DataFrame, corpus: DataFrame, models: int,
                          similarity: str = "dot", n_corpus: int | None = None) -> DataFrame:
    """M8 of all models in one pass: a row per ``model`` (0, 1, ...)."""
    return _weighted_means(multi_query_metrics_models(rows, queries, corpus, models, similarity, None, n_corpus), "model")


def _weighted_means(per_q: DataFrame, *by: str) -> DataFrame:
    total = F.sum("weight")
    return per_q.groupBy(*by).agg(*[F.coalesce(F.sum(F.col(c) * F.col("weight")) / total, F.lit(0.0)).alias(c)
                                    for c in METRIC_COLS], total.alias("n_rows"))


def simulated_metrics(pairs: DataFrame, model: str, cfg: EvalConfig = DEFAULT_CONFIG,
                      similarity_col: str = "similarity") -> DataFrame:
    """M9/M10 long table ``model, row_id, metric, value``.

    ``pairs``: ``row_id, context_empty, similarity`` for one model. The
    similarity itself is unclamped; each simulated metric is
    clamp(s*scale + U(-w, w)) with U from a hash of (seed, model, row, metric).
    Empty contexts give 0 for everything."""
    return simulated_models(pairs.withColumn("s0", F.col(similarity_col)), [model], cfg)


def simulated_models(pairs: DataFrame, models: list[str], cfg: EvalConfig = DEFAULT_CONFIG) -> DataFrame:
    """:func:`simulated_metrics` of several models in one pass: ``pairs`` has ``row_id,
    context_empty, s0, s1, ...``, a similarity per model."""
    empty = F.col("context_empty")
    items = []
    for m, model in enumerate(models):
        s = F.col(f"s{m}")
        values = [("similarity", s)]
        for name, scale, width in cfg.simulated:
            u = hash_uniform(cfg.seed, model, F.col("row_id"), name)
            values.append((name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * F.lit(scale) + (u * 2 - 1) * F.lit(width)))))
        items += [F.struct(F.lit(model).alias("model"), F.lit(name).alias("metric"), F.lit(i).alias("metric_pos"),
                           F.when(empty, F.lit(0.0)).otherwise(v).alias("value")) for i, (name, v) in enumerate(values)]
    return pairs.select("row_id", F.inline(F.array(*items))).select("model", "row_id", "metric", "metric_pos", "value")


def dataset_composition(rows: DataFrame) -> DataFrame:
    """Total, positive (relevance 1.0) and negative (0.0) row counts."""
    return rows.agg(F.count(F.lit(1)).alias("total_examples"),
                    F.count_if(F.col("relevance") == 1.0).alias("positive_examples"),
                    F.count_if(F.col("relevance") == 0.0).alias("negative_examples"))
