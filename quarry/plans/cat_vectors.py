"""Catalogue: retrieval over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.metrics import judged_hits, judgements, own_rank
from quarry.operators.encode import HashEncoder
from quarry.operators.retrieve import pair_similarity, rank_before, top_k
from quarry.operators.keys import text_key
from quarry.plans.common import emb_inputs, emb_rows, eval_set, model_vectors
from quarry.operators.cell_index import build_index, pruned_top_k
from quarry.operators.skew import heavy_hitters, salted_join
from quarry.operators.vector_index import VectorIndex
from quarry.plans.registry import query
from quarry.session import scratch_dir, stage_table
from quarry.sources.tables import table
from quarry.plans.sqlfrag import EVAL_SET_CTES, cos_sql, emb_ctes, hash_vec_cte


def _round(c, name):
    return F.round(c, 6).alias(name)


@query("cosine_topk", sql=f"""
WITH {emb_ctes()}
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def cosine_topk(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    h = top_k(q, c, 5, "cosine")
    return h.select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))


@query("dot_topk", sql=f"""
WITH {emb_ctes(sim='dot')}
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def dot_topk(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    h = top_k(q, c, 5, "dot")
    return h.select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))


@query("own_rank", sql=f"""
WITH {emb_ctes()}
SELECT r.row_id, r.query_id, r.ctx_id, r.relevance, k.rank::INTEGER AS own_rank
FROM rows r LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) k USING (query_id, ctx_id)""")
def own_rank_q(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    r = own_rank(rows, top_k(q, c, 5, "cosine"))
    return r.select("row_id", "query_id", "ctx_id", "relevance", "own_rank")


@query("full_rank", sql=f"""
WITH {emb_ctes()}
SELECT r.row_id, k.rank AS full_rank
FROM rows r JOIN ranked k USING (query_id, ctx_id)""")
def full_rank(spark, sf):
    """E7 without emitting the full ranking: the full-depth rank of each
    row's own context, counted block by block."""
    rows, q, c = emb_inputs(spark, sf)
    qv = q.select("query_id", F.col("embedding").alias("_qe"))
    cv = c.select("ctx_id", F.col("embedding").alias("_ce"))
    own = (rows.join(qv, "query_id").join(cv, "ctx_id")
               .withColumn("thr_score", pair_similarity(F.col("_qe"), F.col("_ce"), "cosine")))
    thr = own.select("row_id", F.col("_qe").alias("embedding"), "thr_score",
                     F.col("ctx_id").alias("thr_ctx"))
    return rank_before(thr, c, "cosine", key="row_id").select(
        "row_id", F.col("rank").alias("full_rank"))


@query("paired_cosine", sql=f"""
WITH {emb_ctes()}
SELECT r.row_id, round({cos_sql('q.v', 'c.v')}, 6) AS score
FROM rows r JOIN e q ON q.vec_id = r.query_id JOIN e c ON c.vec_id = r.ctx_id""")
def paired_cosine(spark, sf):
    rows = emb_rows(spark, sf)
    v = model_vectors(spark, sf, 64)
    qv = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_qe"))
    cv = v.select(F.col("vec_id").alias("ctx_id"), F.col("embedding").alias("_ce"))
    p = rows.join(qv, "query_id").join(cv, "ctx_id")
    return p.select("row_id", _round(pair_similarity(F.col("_qe"), F.col("_ce"), "cosine"), "score"))


@query("judgements", sql=f"""
WITH {EVAL_SET_CTES}
SELECT query, md5(context) AS context_md5, arg_max(relevance, row_id) AS gain, count(*) AS n_rows
FROM eval_rows GROUP BY query, context""")
def judgements_q(spark, sf):
    ev = eval_set(spark, sf)
    j = ev.groupBy("query", "context").agg(F.max_by("relevance", "row_id").alias("gain"),
                                          F.count(F.lit(1)).alias("n_rows"))
    return j.select("query", F.md5("context").alias("context_md5"), "gain", "n_rows")


@query("judgement_lookup", sql=f"""
WITH {emb_ctes()},
j AS (SELECT query_id, ctx_id, arg_max(relevance, row_id) AS gain FROM rows GROUP BY ALL)
SELECT k.query_id, k.rank::INTEGER AS rank, k.ctx_id, coalesce(j.gain, 0.0) AS gain
FROM (SELECT * FROM ranked WHERE rank <= 5) k LEFT JOIN j USING (query_id, ctx_id)""")
def judgement_lookup(spark, sf):
    rows, q, c = emb_inputs(spark, sf)
    jh = judged_hits(top_k(q, c, 5, "cosine"), judgements(rows))
    return jh.select("query_id", "rank", "ctx_id", "gain")


@query("example_queries", sql=f"""
WITH {emb_ctes()},
cent AS (
  SELECT label, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY label, pos)
  GROUP BY label),
sc AS (
  SELECT cent.label, cs.ctx_id, {cos_sql('cent.v', 'c.v')} AS score
  FROM cent CROSS JOIN cs JOIN e c ON c.vec_id = cs.ctx_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, ctx_id) AS rank FROM sc)
SELECT label, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM rk WHERE rank <= 3""")
def example_queries(spark, sf):
    """Ad-hoc queries (here the label centroids) -> top 3 contexts."""
    rows, q, c = emb_inputs(spark, sf)
    v = model_vectors(spark, sf, 64)
    comp = v.select("label", F.posexplode("embedding").alias("pos", "x"))
    cent = (comp.groupBy("label", "pos").agg(F.avg("x").alias("m"))
                .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_v"))
                .select(F.col("label").cast("bigint").alias("query_id"),
                        F.transform("_v", lambda s: s["m"]).alias("embedding")))
    h = top_k(cent, c, 3, "cosine")
    return h.select(F.col("query_id").cast("int").alias("label"), "rank", "ctx_id",
                    _round(F.col("score"), "score"))


_TWIN = 1 << 20     # every vector once more under a shifted id: all scores are tied


def _twins(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    c = e.select(F.col("vec_id").alias("ctx_id"), "embedding")
    return q, c.unionByName(c.withColumn("ctx_id", F.col("ctx_id") + F.lit(_TWIN)))


_TWIN_CTES = f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT vec_id AS ctx_id, v FROM e UNION ALL SELECT vec_id + {_TWIN}, v FROM e),
s AS (SELECT e.vec_id AS query_id, c.ctx_id,
             CASE WHEN list_dot_product(e.v, e.v) > 0 AND list_dot_product(c.v, c.v) > 0
                  THEN list_cosine_similarity(e.v, c.v) ELSE 0 END AS score FROM e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ctx_id) AS rank FROM s)"""


@query("topk_ties", sql=f"""
WITH {_TWIN_CTES}
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def topk_ties(spark, sf):
    q, c = _twins(spark, sf)
    return top_k(q, c, 5, "cosine").select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))


@query("full_rank_ties", sql=f"""
WITH {_TWIN_CTES}
SELECT query_id, rank AS full_rank FROM r WHERE ctx_id = query_id + {_TWIN}""")
def full_rank_ties(spark, sf):
    q, c = _twins(spark, sf)
    thr = q.select("query_id", "embedding", pair_similarity(F.col("embedding"), F.col("embedding"), "cosine")
                   .alias("thr_score"), (F.col("query_id") + F.lit(_TWIN)).alias("thr_ctx"))
    return rank_before(thr, c, "cosine").select("query_id", F.col("rank").alias("full_rank"))


# -- keys with much of the rows -----------------------------------------------------

HEAVY_SHARE = 0.05


@query("heavy_queries", sql=f"""
WITH {EVAL_SET_CTES}
SELECT query, count(*) AS n_rows, (SELECT count(*) FROM eval_rows WHERE query IS NOT NULL) AS total
FROM eval_rows GROUP BY query HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM eval_rows WHERE query IS NOT NULL)""")
def heavy_queries(spark, sf):
    """The query texts on at least a twentieth of the eval rows, by a mergeable sketch."""
    found = heavy_hitters(eval_set(spark, sf).select("query"), "query", HEAVY_SHARE)
    return spark.createDataFrame([(k, n, found.total) for k, n in found.keys], "query string, n_rows bigint, total bigint")


@query("salted_query_ids", sql=f"""
WITH {EVAL_SET_CTES},
q AS (SELECT query, min(row_id) AS query_id FROM eval_rows GROUP BY query)
SELECT row_id, query_id, relevance FROM eval_rows JOIN q USING (query)""")
def salted_query_ids(spark, sf):
    """Rows and their query ids joined with the heavy query texts salted."""
    rows = stage_table(eval_set(spark, sf).select("row_id", "query", "relevance"), "heavy-rows")
    q = rows.groupBy("query").agg(F.min("row_id").alias("query_id"))
    return salted_join(rows, q, "query", heavy_hitters(rows, "query", HEAVY_SHARE)).select("row_id", "query_id", "relevance")


# -- cells that a bound skips ------------------------------------------------------

def _pruned(spark, sf, similarity):
    rows, q, c = emb_inputs(spark, sf)
    return pruned_top_k(q, build_index(c, similarity), 5)


@query("pruned_topk", sql=f"""
WITH {emb_ctes()}
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def pruned_topk(spark, sf):
    """E3/E6 with the cell index: the rows of cosine_topk."""
    return _pruned(spark, sf, "cosine")[0].select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))


@query("pruned_dot_topk", sql=f"""
WITH {emb_ctes(sim='dot')}
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def pruned_dot_topk(spark, sf):
    """E4/E6 with the cell index: the rows of dot_topk."""
    return _pruned(spark, sf, "dot")[0].select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))


@query("pruned_share")
def pruned_share(spark, sf):
    """How many of the query x cell pairs the bound skips, benchmark texts against all
    documents (a report; the hits are exact)."""
    text, enc = F.coalesce("text", F.lit("")), INDEX_MODELS["hash64"]
    c = stage_table(table(spark, sf, "documents", spread_rows=True).select(F.col("doc_id").alias("ctx_id"), enc(text).alias("embedding")),
                    "pruned-corpus")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), enc(text).alias("embedding"))
    parts = [pruned_top_k(q, build_index(c, s), 5)[1].withColumn("similarity", F.lit(s)) for s in ("cosine", "dot")]
    return parts[0].unionByName(parts[1])


# -- a kept index: the benchmark texts first, then the documents -----------------

INDEX_MODELS = {"hash64": HashEncoder(64, 1), "hash32": HashEncoder(32, 2)}


def _grown_index(spark, sf):
    index = VectorIndex(spark, scratch_dir(spark, "index"))
    b = table(spark, sf, "benchmark").select(F.coalesce("text", F.lit("")).alias("text"))
    d = table(spark, sf, "documents", spread_rows=True).select(F.coalesce("text", F.lit("")).alias("text"))
    return index, [index.update(texts, INDEX_MODELS) for texts in (b, b.unionByName(d))]


@query("index_update", sql="""
WITH b AS (SELECT DISTINCT coalesce(text, '') AS text FROM benchmark),
d AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents)
SELECT m.model, r.step::INTEGER AS step, CASE step WHEN 0 THEN (SELECT count(*) FROM b)
       ELSE (SELECT count(*) FROM d WHERE text NOT IN (SELECT text FROM b)) END AS encoded
FROM (VALUES ('hash64'), ('hash32')) m(model), (VALUES (0), (1)) r(step)""")
def index_update(spark, sf):
    """A second run over a grown corpus encodes the new texts only."""
    _, steps = _grown_index(spark, sf)
    return spark.createDataFrame([(m, i, n) for i, counts in enumerate(steps) for m, n in counts.items()],
                                 "model string, step int, encoded bigint")


@query("index_retrieval", sql=f"""
WITH qs AS (SELECT item_id, coalesce(text, '') AS text FROM benchmark),
ds AS (SELECT min(doc_id) AS ctx_id, coalesce(text, '') AS text FROM documents GROUP BY ALL),
{hash_vec_cte('qv', 'qs', 'item_id', 'text', 64, 1)},
{hash_vec_cte('dv', 'ds', 'ctx_id', 'text', 64, 1)},
s AS (SELECT q.vid AS query_id, d.vid AS ctx_id, {cos_sql('q.v', 'd.v')} AS score FROM qv q, dv d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ctx_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, ctx_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def index_retrieval(spark, sf):
    """Retrieval with the vectors of the grown, compacted index; no text is encoded."""
    index, _ = _grown_index(spark, sf)
    index.compact("hash64")
    key = text_key(F.coalesce("text", F.lit(""))).alias("text_key")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), key)
    c = table(spark, sf, "documents").select(key, "doc_id").groupBy("text_key").agg(F.min("doc_id").alias("ctx_id"))
    h = top_k(stage_table(index.lookup(q, "query_id", "hash64"), "index-queries"), index.lookup(c, "ctx_id", "hash64"), 5)
    return h.select("query_id", "rank", "ctx_id", _round(F.col("score"), "score"))
