"""Catalogue: metric families, simulated metrics and model comparison
(M1-M17) over the embeddings table with models A (64 d) and B (folded to 32 d)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG
from quarry.operators.compare import (best_metric, best_model, improvement, model_means,
                                      one_metric)
from quarry.operators.metrics import (METRIC_COLS, dataset_composition, evaluate_multi_models,
                                      evaluate_rowwise, evaluate_rowwise_models, multi_query_metrics,
                                      rowwise_metrics, simulated_models)
from quarry.operators.retrieve import best_hits, pair_similarity, stacked_pass
from quarry.plans.common import MODELS, emb_inputs, emb_models, emb_rows, stacked_vectors
from quarry.plans.registry import query
from quarry.plans.sqlfrag import SEED, cos_sql, emb_ctes, h
from quarry.sources.tables import table

def r6(cols=METRIC_COLS):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def _rowwise_sql(p: str) -> str:
    def prec(k):
        return (f"CASE WHEN relevance = 1.0 THEN (CASE WHEN own_rank <= {k} THEN 1.0::DOUBLE / {k} "
                f"ELSE 0.0 END) ELSE (CASE WHEN own_rank <= {k} THEN 0.0 ELSE 1.0 END) END")
    return f"""{p}own AS (
  SELECT r.*, k.rank AS own_rank FROM {p}rows r
  LEFT JOIN (SELECT * FROM {p}ranked WHERE rank <= 5) k USING (query_id, ctx_id)),
{p}m AS (
  SELECT row_id, query_id, own_rank, {prec(1)} AS p_at_1, {prec(3)} AS p_at_3, {prec(5)} AS p_at_5,
         CASE WHEN relevance = 1.0 AND own_rank <= 5 THEN 1.0::DOUBLE / own_rank ELSE 0.0 END AS mrr,
         CASE WHEN relevance = 1.0 AND own_rank <= 5 THEN 1.0::DOUBLE / log2(own_rank + 1)
              ELSE 0.0 END AS ndcg_at_5
  FROM {p}own)"""


ROWWISE = f"WITH {emb_ctes()}, {_rowwise_sql('')}"


@query("row_precision", sql=f"""{ROWWISE}
SELECT row_id, own_rank::INTEGER AS own_rank, round(p_at_1, 6) AS p_at_1, round(p_at_3, 6) AS p_at_3,
       round(p_at_5, 6) AS p_at_5 FROM m""")
def row_precision(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    m = rowwise_metrics(rows, q, c, "cosine")
    return m.select("row_id", "own_rank", *r6()[:3])


@query("row_mrr", sql=f"{ROWWISE}\nSELECT row_id, round(mrr, 6) AS mrr FROM m")
def row_mrr(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    return rowwise_metrics(rows, q, c, "cosine").select("row_id", r6()[3])


@query("row_ndcg", sql=f"{ROWWISE}\nSELECT row_id, round(ndcg_at_5, 6) AS ndcg_at_5 FROM m")
def row_ndcg(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    return rowwise_metrics(rows, q, c, "cosine").select("row_id", r6()[4])


def _avg_sql(p: str, model: str, pos: int) -> str:
    return (f"SELECT '{model}' AS model, {pos} AS model_pos, "
            + ", ".join(f"round(avg({c}), 6) AS {c}" for c in METRIC_COLS)
            + f", count(*) AS n_rows FROM {p}m")


BOARD_CTES = "WITH " + ",\n".join(
    f"{emb_ctes(dims=d, p=f'{n.lower()}_')},\n{_rowwise_sql(f'{n.lower()}_')}" for n, d in MODELS)
BOARD_SQL = "\nUNION ALL\n".join(_avg_sql(f"{n.lower()}_", n, i) for i, (n, _) in enumerate(MODELS))


def _named(df):
    """Model numbers to the names of MODELS, with their place."""
    names = F.array(*[F.lit(n) for n, _ in MODELS])
    return df.withColumn("model_pos", F.col("model")).withColumn("model", F.element_at(names, F.col("model") + 1))


def _board(spark, sf):
    rows, q, c = emb_models(spark, sf)
    hits = best_hits(stacked_pass(q, c, len(MODELS), 5, "cosine"), 5, ("model", "query_id"))
    return _named(evaluate_rowwise_models(rows, hits, len(MODELS))).select("model", "model_pos", *r6(), "n_rows")


@query("evaluate_rowwise", sql=f"WITH {emb_ctes()}, {_rowwise_sql('')}\n{_avg_sql('', 'A', 0)}")
def evaluate_rowwise_q(spark, sf):
    rows, q, c = emb_inputs(spark, sf, 64)
    e = evaluate_rowwise(rows, q, c, "cosine")
    return e.select(F.lit("A").alias("model"), F.lit(0).alias("model_pos"), *r6(), "n_rows")


@query("leaderboard", sql=f"{BOARD_CTES}\n{BOARD_SQL}")
def leaderboard(spark, sf):
    return _board(spark, sf)


@query("best_model", sql=f"""{BOARD_CTES},
board AS ({BOARD_SQL})
SELECT model, mrr FROM board ORDER BY mrr DESC, model_pos LIMIT 1""")
def best_model_q(spark, sf):
    return best_model(_board(spark, sf)).select("model", "mrr")


def _multi_sql(p: str) -> str:
    def prec(k):
        return f"sum(CASE WHEN gain = 1.0 AND rank <= {k} THEN 1.0 ELSE 0.0 END) / {k}.0"
    return f"""{p}j AS (SELECT query_id, ctx_id, arg_max(relevance, row_id) AS gain FROM {p}rows GROUP BY ALL),
{p}w AS (SELECT query_id, count(*) AS weight FROM {p}rows GROUP BY ALL),
{p}rk AS (SELECT k.*, coalesce(j.gain, 0.0) AS gain FROM {p}ranked k LEFT JOIN {p}j j USING (query_id, ctx_id)),
{p}prec AS (
  SELECT query_id, {prec(1)} AS p_at_1, {prec(3)} AS p_at_3, {prec(5)} AS p_at_5,
         sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0.0 END) AS dcg,
         min(CASE WHEN gain = 1.0 THEN rank END) AS first_rel
  FROM {p}rk GROUP BY query_id),
{p}ideal AS (
  SELECT query_id, sum(gain / log2(i + 1)) AS idcg FROM (
    SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, ctx_id) AS i
    FROM {p}j WHERE gain > 0) WHERE i <= 5 GROUP BY query_id),
{p}mq AS (
  SELECT w.query_id, w.weight, coalesce(p_at_1, 0.0) AS p_at_1, coalesce(p_at_3, 0.0) AS p_at_3,
         coalesce(p_at_5, 0.0) AS p_at_5, coalesce(1.0::DOUBLE / first_rel, 0.0) AS mrr,
         CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0) / idcg ELSE 0.0 END AS ndcg_at_5
  FROM {p}w w LEFT JOIN {p}prec USING (query_id) LEFT JOIN {p}ideal USING (query_id))"""


MULTI = f"WITH {emb_ctes(sim='dot')}, {_multi_sql('')}"


def _multi_q(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    return multi_query_metrics(rows, q, c, "dot")


@query("multi_precision", sql=f"""{MULTI}
SELECT query_id, weight, round(p_at_1, 6) AS p_at_1, round(p_at_3, 6) AS p_at_3,
       round(p_at_5, 6) AS p_at_5 FROM mq""")
def multi_precision(spark, sf):
    return _multi_q(spark, sf).select("query_id", "weight", *r6()[:3])


@query("multi_mrr", sql=f"{MULTI}\nSELECT query_id, weight, round(mrr, 6) AS mrr FROM mq")
def multi_mrr(spark, sf):
    return _multi_q(spark, sf).select("query_id", "weight", r6()[3])


@query("multi_ndcg", sql=f"{MULTI}\nSELECT query_id, weight, round(ndcg_at_5, 6) AS ndcg_at_5 FROM mq")
def multi_ndcg(spark, sf):
    return _multi_q(spark, sf).select("query_id", "weight", r6()[4])


@query("evaluate_multi", sql=f"""WITH """ + ",\n".join(
    f"{emb_ctes(dims=d, sim='dot', p=f'{n.lower()}_')},\n{_multi_sql(f'{n.lower()}_')}"
    for n, d in MODELS) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS model, " + ", ".join(
        f"round(sum({c} * weight) / sum(weight), 6) AS {c}" for c in METRIC_COLS)
    + f", sum(weight)::BIGINT AS n_rows FROM {n.lower()}_mq" for n, _ in MODELS))
def evaluate_multi_q(spark, sf):
    rows, q, c = emb_models(spark, sf)
    return _named(evaluate_multi_models(rows, q, c, len(MODELS), "dot")).select("model", *r6(), "n_rows")


# -- simulated metrics ---------------------------------------------------------

def _sim_long(spark, sf):
    v = stacked_vectors(spark, sf)
    side = lambda key, p: v.select(F.col("vec_id").alias(key), *[F.col(f"e{i}").alias(f"_{p}{i}") for i in range(len(MODELS))])
    p = (emb_rows(spark, sf, outer=True).join(side("query_id", "q"), "query_id").join(side("ctx_id", "c"), "ctx_id", "left")
         .select("row_id", "context_empty", *[pair_similarity(F.col(f"_q{i}"), F.col(f"_c{i}"), "cosine").alias(f"s{i}")
                                              for i in range(len(MODELS))]))
    return simulated_models(p, [name for name, _ in MODELS])


def _sim_sql() -> str:
    ctes = [emb_ctes(dims=d, outer=True, p=f"{n.lower()}_") for n, d in MODELS]
    sims = []
    for n, _ in MODELS:
        p = f"{n.lower()}_"
        sims.append(f"""SELECT '{n}' AS model, r.row_id, r.context_empty, {cos_sql('q.v', 'c.v')} AS s
  FROM {p}rows r JOIN {p}e q ON q.vec_id = r.query_id LEFT JOIN {p}e c ON c.vec_id = r.ctx_id""")
    longs = ["SELECT model, row_id, 'similarity' AS metric, 0 AS metric_pos, "
             "CASE WHEN context_empty THEN 0.0 ELSE s END AS value, context_empty FROM sim"]
    for i, (name, scale, width) in enumerate(DEFAULT_CONFIG.simulated, start=1):
        u = f"({h([str(SEED), 'model', 'row_id', repr(name)])})::DOUBLE / 4294967296.0"
        longs.append(
            f"SELECT model, row_id, '{name}', {i}, CASE WHEN context_empty THEN 0.0 ELSE "
            f"greatest(0.0, least(1.0, s * {scale}::DOUBLE + (({u}) * 2 - 1) * {width}::DOUBLE)) END, "
            f"context_empty FROM sim")
    return ("WITH " + ",\n".join(ctes) + ",\nsim AS (" + "\nUNION ALL\n".join(sims) + "),\n"
            + "long AS (" + "\nUNION ALL\n".join(longs) + ")")


SIM = _sim_sql()


@query("simulated_metrics", sql=f"""{SIM}
SELECT model, row_id, metric, round(value, 6) AS value FROM long""")
def simulated_metrics_q(spark, sf):
    return _sim_long(spark, sf).select("model", "row_id", "metric", F.round("value", 6).alias("value"))


@query("empty_context_metrics", sql=f"""{SIM}
SELECT model, row_id, metric, value FROM long WHERE context_empty""")
def empty_context_metrics(spark, sf):
    rows = emb_rows(spark, sf, outer=True).filter(F.col("context_empty")).select("row_id")
    return _sim_long(spark, sf).join(rows, "row_id", "left_semi").select("model", "row_id", "metric", "value")


MEANS = f"""{SIM},
means AS (SELECT model, metric, min(metric_pos) AS metric_pos, avg(value) AS value FROM long GROUP BY ALL),
impr AS (
  SELECT b.metric, b.metric_pos, b.value AS base, c.value AS candidate, c.value - b.value AS absolute,
         CASE WHEN b.value <> 0 THEN (c.value - b.value) / b.value * 100 ELSE 0.0 END AS relative
  FROM means b JOIN means c ON b.metric = c.metric AND b.model = 'A' AND c.model = 'B')"""


def _impr(spark, sf):
    return improvement(model_means(_sim_long(spark, sf)), "A", "B")


@query("model_means", sql=f"""{MEANS}
SELECT model, metric, metric_pos, round(value, 6) AS value FROM means""")
def model_means_q(spark, sf):
    m = model_means(_sim_long(spark, sf))
    return m.select("model", "metric", "metric_pos", F.round("value", 6).alias("value"))


IMPR_COLS = ("base", "candidate", "absolute", "relative")


@query("improvement", sql=f"""{MEANS}
SELECT metric, metric_pos, {", ".join(f"round({c}, 6) AS {c}" for c in IMPR_COLS)} FROM impr""")
def improvement_q(spark, sf):
    return _impr(spark, sf).select("metric", "metric_pos", *[F.round(c, 6).alias(c) for c in IMPR_COLS])


@query("best_metric", sql=f"""{MEANS},
pick AS (
  SELECT metric, relative, metric_pos, 0 AS prio FROM impr WHERE base <> 0
  UNION ALL SELECT 'n/a', NULL, 1073741824, 1)
SELECT metric, round(relative, 6) AS relative FROM pick ORDER BY prio, relative DESC, metric_pos LIMIT 1""")
def best_metric_q(spark, sf):
    return best_metric(_impr(spark, sf)).select("metric", F.round("relative", 6).alias("relative"))


@query("one_metric", sql=f"""{MEANS}
SELECT metric, {", ".join(f"round({c}, 6) AS {c}" for c in IMPR_COLS)} FROM impr
WHERE metric = 'simulated_faithfulness'""")
def one_metric_q(spark, sf):
    return one_metric(_impr(spark, sf)).select("metric", *[F.round(c, 6).alias(c) for c in IMPR_COLS])


@query("dataset_composition", sql="""
SELECT count(*) AS total_examples, count(*) FILTER (WHERE quality::DOUBLE = 1.0) AS positive_examples,
       count(*) FILTER (WHERE quality::DOUBLE = 0.0) AS negative_examples FROM labels""")
def dataset_composition_q(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("relevance"))
    return dataset_composition(lab)
