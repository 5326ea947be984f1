"""End-to-end pipelines (P1-P4) as compositions of the operators.

Every function takes and returns DataFrames; intermediate tables that are
read more than once are written as Parquet to the shared checkpoint folder (the
equivalent of the hand-off files between the original scripts), which also
cuts lineage so lost executors only recompute from there (``drop_staged``
removes them). Context texts are keyed: each distinct one is written once, rows
carry its key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG, EXAMPLE_QUERIES, EvalConfig
from quarry.operators.compare import (best_metric, best_model, improvement, model_means,
                                      one_metric, wide_to_long)
from quarry.operators.encode import embed_table, encode_errors, index_texts
from quarry.operators.keys import distinct_texts, text_key
from quarry.operators.metrics import (METRIC_COLS, METRICS, dataset_composition, evaluate_multi_models,
                                      evaluate_rowwise_models, simulated_models)
from quarry.operators.parse import to_documents
from quarry.operators.querygen import generate_queries
from quarry.operators.responses import failed_requests, parse_responses, render_requests
from quarry.operators.retrieve import best_hits, pair_similarity, stacked_pass
from quarry.operators.skew import BROADCAST_ROWS, keyed_join
from quarry.operators.training import mini_batches, run_manifest, training_examples, tuple_refs
from quarry.operators.vector_index import VectorIndex
from quarry.session import stage_table
from quarry.sources.tables import spread

Encoder = Callable[[Column], Column]
SIDES = {"q": "query", "c": "context"}


# -- P1 -------------------------------------------------------------------------

def build_eval_set(entries: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG, text_col: str = "text",
                   id_col: str = "entry_id") -> DataFrame:
    """Template eval set from tagged entries (one narrow stage)."""
    return generate_queries(entries, cfg, text_col, id_col)


# -- shared: text eval rows -> ids and vectors ------------------------------------

@dataclass
class IndexedRows:
    rows: DataFrame      # row_id, query_id, ctx_id, relevance
    queries: DataFrame   # query_id, text
    contexts: DataFrame  # ctx_id, text
    keys: DataFrame      # ctx_id, text_key
    texts: DataFrame     # text_key, text of the contexts
    n_queries: int
    n_contexts: int


def index_eval_rows(eval_rows: DataFrame) -> IndexedRows:
    """Ids for the distinct query and context texts; rows keep only ids.

    The rows are written with their (short) queries and the keys of both texts,
    the distinct contexts in a second narrow pass over the source; no context text
    is joined."""
    # missing texts are empty texts (B15): no row is lost in the joins on keys
    src = eval_rows.select("row_id", F.coalesce("query", F.lit("")).alias("query"),
                           F.coalesce("context", F.lit("")).alias("context"), "relevance")
    rows = stage_table(src.select("row_id", "query", text_key(F.col("query")).alias("q_key"),
                                  text_key(F.col("context")).alias("c_key"), "relevance"), "eval-rows")
    qi, nq = index_texts(rows, "query", "query_id", with_total=True)
    ci, nc = index_texts(src, "context", "ctx_id", with_total=True)
    # one query text may cover most rows: its key is broadcast or salted, never one task's
    ids = keyed_join(rows.select("row_id", "q_key", "c_key", "relevance"),
                     qi.select(F.col("text_key").alias("q_key"), "query_id"), "q_key", nq)
    c_keys = ci.select(F.col("text_key").alias("c_key"), "ctx_id")
    if nc > BROADCAST_ROWS:             # a salted join deals a written table
        ids = stage_table(ids, "eval-query-ids")
    ids = keyed_join(ids, c_keys, "c_key", nc).select("row_id", "query_id", "ctx_id", "relevance")
    return IndexedRows(stage_table(ids, "eval-ids"), qi.select("query_id", "text"),
                       ci.select("ctx_id", "text"), ci.select("ctx_id", "text_key"),
                       ci.select("text_key", "text"), nq, nc)


# -- P2 -------------------------------------------------------------------------

def leaderboard(eval_rows: DataFrame, models: dict[str, Encoder],
                example_queries: tuple[str, ...] = EXAMPLE_QUERIES, k_examples: int = 3,
                index: VectorIndex | None = None) -> dict:
    """Row-judged metrics per model, best model by MRR (earlier wins ties),
    example queries answered by the best model, dataset composition.

    The example queries join the eval queries under ids below the least id of
    these, and all models' vectors lie in one table: a single top-k pass scores the
    corpus for all models. With a kept ``index`` only contexts it has not seen are encoded
    (the model names are its partitions); it is updated first."""
    spark = eval_rows.sparkSession
    ix = index_eval_rows(eval_rows)
    least = ix.queries.agg(F.min("query_id")).first()[0] or 0
    ex = spark.createDataFrame([(least - 1 - i, q) for i, q in enumerate(example_queries)],
                               "query_id bigint, text string")
    k, names, n = max(5, k_examples), list(models), len(models)
    encoders = list(models.values())
    qv = embed_table(ix.queries.unionByName(ex), "query_id", encoders)
    if index is None:
        cv = embed_table(ix.contexts, "ctx_id", encoders)
    else:
        index.update(ix.texts, models, distinct=True)
        cv = index.stacked(ix.keys, "ctx_id", names)
    cv = spread(cv)
    hits = stage_table(best_hits(stacked_pass(qv, cv, n, k, "cosine", ix.n_contexts), k, ("model", "query_id")), "hits")
    own = hits.filter((F.col("query_id") >= least) & (F.col("rank") <= 5))
    board = evaluate_rowwise_models(ix.rows, own, n)
    board = stage_table(board.select(_name(names, F.col("model")).alias("model"), F.col("model").alias("model_pos"),
                                     *METRIC_COLS, "n_rows"), "board")
    best = best_model(board).select("model", "mrr")
    ex0 = ex.select((F.lit(least - 1) - F.col("query_id")).alias("query_id"), F.col("text").alias("query"))
    ex_hits = (hits.filter((F.col("query_id") < least) & (F.col("rank") <= k_examples))
               .select(_name(names, F.col("model")).alias("model"),
                       (F.lit(least - 1) - F.col("query_id")).alias("query_id"), "rank", "ctx_id", "score")
               .join(best.select("model"), "model", "left_semi")
               .join(ex0, "query_id"))
    # k_examples hits of each example query: sent to the texts, which stay where they lie
    ex_hits = (ix.contexts.withColumnRenamed("text", "context").join(F.broadcast(ex_hits), "ctx_id")
               .select("ctx_id", *[c for c in ex_hits.columns if c != "ctx_id"], "context"))
    return {"board": board, "best": best, "examples": ex_hits,
            "composition": dataset_composition(ix.rows)}


def _name(names: list[str], model: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), model + 1)


# -- P3 -------------------------------------------------------------------------

def build_training_set(eval_rows: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG, epochs: int = 3,
                       learning_rate: float = 2e-5, base_model: str = "base",
                       generated_at: str | None = None) -> dict:
    """Training tuples, their batches and the run record; the latter two need the
    tuples' keys only. The positives are parsed once, for all three."""
    refs = tuple_refs(eval_rows, cfg)
    keys = refs.select("row_id", F.posexplode("queries").alias("aug_pos", "query")).drop("query")
    return {"tuples": training_examples(eval_rows, cfg.num_negatives, cfg, refs),
            "batches": mini_batches(keys, ["row_id", "aug_pos"], cfg.batch_size, epochs, cfg.seed),
            "manifest": run_manifest(keys, base_model, epochs, cfg.batch_size, learning_rate,
                                     generated_at=generated_at)}


def compare_models(eval_rows: DataFrame, base: Encoder, candidate: Encoder,
                   similarity: str = "dot") -> DataFrame:
    """Multi-relevant metrics of two encoders and their improvement table."""
    ix = index_eval_rows(eval_rows)
    names, encoders = ["base", "candidate"], [base, candidate]
    qv = embed_table(ix.queries, "query_id", encoders)
    cv = spread(embed_table(ix.contexts, "ctx_id", encoders))
    e = evaluate_multi_models(ix.rows, qv, cv, 2, similarity, ix.n_contexts)
    e = e.withColumn("model", _name(names, F.col("model")))
    return improvement(wide_to_long(e, list(METRIC_COLS), list(METRICS)), "base", "candidate")


# -- P4 -------------------------------------------------------------------------

def build_requests(entries: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG) -> DataFrame:
    return render_requests(to_documents(entries, cfg=cfg), cfg)


def ingest_responses(entries: DataFrame, responses: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG):
    """Test set (query, context = body, typed ``metadata`` struct) and the
    entries without a usable response."""
    docs = to_documents(entries, cfg=cfg)
    return (parse_responses(docs, responses, cfg, keep=("metadata",)),
            failed_requests(docs, responses))


def compare_paired(test_set: DataFrame, base: Encoder, candidate: Encoder,
                   cfg: EvalConfig = DEFAULT_CONFIG,
                   order_cols: tuple[str, ...] = ("entry_id", "resp_id", "line_no")) -> dict:
    """Simulated RAG metrics of (query, context) pairs for two encoders.

    Query and context texts are encoded once per distinct text, by both encoders in
    one pass, and their vectors joined back by key; one pass over the rows gives both
    similarities. ``pairs`` tells them with the rows on which a model failed,
    ``errors`` counts the texts it failed on (:class:`~quarry.operators.encode.IsolatingEncoder`)."""
    src = test_set.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in order_cols]).alias("row_id"),
        F.coalesce("query", F.lit("")).alias("query"), F.coalesce("context", F.lit("")).alias("context"))
    empty = F.col("context") == F.lit("")
    rows = stage_table(src.select("row_id", "query", text_key(F.col("query")).alias("q_key"),
                                  text_key(F.col("context")).alias("c_key"), empty.alias("context_empty")), "pairs")
    texts = {"q": distinct_texts(rows.select("query"), F.col("query")),
             "c": distinct_texts(src.filter(~empty).select("context"), F.col("context"))}
    p = rows.select("row_id", "q_key", "c_key", "context_empty")
    errors = []
    for side, how in (("q", "inner"), ("c", "left")):
        v = embed_table(texts[side], "text_key", [base, candidate])
        errors.append(encode_errors(v, ["base", "candidate"]).withColumn("side", F.lit(SIDES[side])))
        p = p.join(v.select(F.col("text_key").alias(f"{side}_key"), F.col("e0").alias(f"_{side}0"),
                            F.col("e1").alias(f"_{side}1")), f"{side}_key", how)
    # a text that no model could encode has no vector: its pairs have a similarity of 0
    p = stage_table(p.select("row_id", "context_empty", *[c for i in (0, 1) for c in (
        pair_similarity(F.col(f"_q{i}"), F.col(f"_c{i}")).alias(f"s{i}"),
        (F.col(f"_q{i}").isNull() | (F.col(f"_c{i}").isNull() & ~F.col("context_empty"))).alias(f"failed{i}"))]),
        "similarities")
    long = simulated_models(p, ["base", "candidate"], cfg)
    impr = stage_table(improvement(model_means(long), "base", "candidate"), "improvement")
    pairs = p.select("row_id", F.inline(F.array(*[F.struct(
        F.lit(name).alias("model"), F.col(f"s{i}").alias("similarity"), F.col(f"failed{i}").alias("failed"))
        for i, name in enumerate(("base", "candidate"))])))
    return {"per_row": long, "improvement": impr, "best_metric": best_metric(impr), "pairs": pairs,
            "errors": reduce(lambda a, b: a.unionByName(b), errors),
            "faithfulness": one_metric(impr, "simulated_faithfulness")}
