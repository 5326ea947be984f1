"""Inputs derived from the test tables, shared by the catalogue modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG
from quarry.plans.sqlfrag import TEST_GENRES, VECTOR_DIMS, fold_sign
from quarry.session import stage_table
from quarry.sources.tables import spread, table

# The test tables carry no tags; entries are tagged from source and language,
# and the first five sources play the role of whitelisted genres.
TEST_CFG = DEFAULT_CONFIG.with_genres(TEST_GENRES)


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", spread_rows=True)
    text = F.concat(F.lit("<"), d.source, F.lit("> </"), d.source, F.lit("> <"), d.lang,
                    F.lit("> </"), d.lang, F.lit("> prompt "), d.text)
    return d.select(F.col("doc_id").alias("entry_id"), text.alias("text"))


def eval_set(spark: SparkSession, sf: str) -> DataFrame:
    from quarry.operators.querygen import generate_queries
    return generate_queries(tagged(spark, sf), TEST_CFG)


def joined(col, sep: str = "|"):
    return F.array_join(col, sep)


# Two "models" over the embeddings table: the vectors as they are, and all 64
# dimensions folded to 32 with seeded signs (see sqlfrag.fold_sign).
MODELS = (("A", 64), ("B", 32))


def _folded(x, dims: int):
    """The vector column for a model of ``dims`` dimensions."""
    if dims == VECTOR_DIMS:
        return x
    x = x.cast("array<double>")
    return F.array(*[reduce(lambda a, b: a + b, [x[j] * F.lit(fold_sign(j)) for j in range(i, VECTOR_DIMS, dims)])
                     for i in range(dims)])


def model_vectors(spark: SparkSession, sf: str, dims: int) -> DataFrame:
    e = table(spark, sf, "embeddings", spread_rows=True)
    return e.select("vec_id", "label", _folded(F.col("embedding"), dims).alias("embedding"))


def stacked_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Both models' vectors side by side, written once: ``vec_id, e0, e1``."""
    e = table(spark, sf, "embeddings", spread_rows=True)
    return spread(stage_table(e.select("vec_id", *[_folded(F.col("embedding"), d).alias(f"e{i}")
                                                   for i, (_, d) in enumerate(MODELS)]), "emb-vectors"))


def emb_rows(spark: SparkSession, sf: str, outer: bool = False) -> DataFrame:
    """Eval rows over the embeddings: query = vector i, contexts = vectors
    i+1..i+3, relevance 1.0 when the labels agree. ``outer`` keeps rows whose
    context id does not exist (empty context)."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_ql"),
                 F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("_off"))
    c = e.select(F.col("vec_id").alias("_cid"), F.col("label").alias("_cl"))
    r = q.join(c, F.col("query_id") + F.col("_off") == F.col("_cid"), "left" if outer else "inner")
    return r.select((F.col("query_id") * 3 + F.col("_off") - 1).alias("row_id"), "query_id",
                    (F.col("query_id") + F.col("_off")).alias("ctx_id"),
                    F.when(F.col("_ql") == F.col("_cl"), F.lit(1.0)).otherwise(F.lit(0.0))
                     .alias("relevance"),
                    F.col("_cid").isNull().alias("context_empty"))


def _emb_sides(rows: DataFrame, vectors: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The vectors that are queries, and those that are contexts, of ``rows``: one join
    with the ids' roles, written once."""
    rest = [c for c in vectors.columns if c != "vec_id"]
    role = lambda c, q: F.struct(F.col(c).alias("vec_id"), F.lit(q).alias("is_q"), F.lit(not q).alias("is_c"))
    roles = (rows.select(F.inline(F.array(role("query_id", True), role("ctx_id", False))))
             .groupBy("vec_id").agg(F.max("is_q").alias("is_q"), F.max("is_c").alias("is_c")))
    both = spread(stage_table(vectors.join(roles, "vec_id"), name))
    return (both.filter("is_q").select(F.col("vec_id").alias("query_id"), *rest),
            both.filter("is_c").select(F.col("vec_id").alias("ctx_id"), *rest))


def emb_inputs(spark: SparkSession, sf: str, dims: int = 64):
    """(rows, query vectors, corpus vectors) for one model."""
    rows = stage_table(emb_rows(spark, sf).drop("context_empty"), "emb-rows")
    return rows, *_emb_sides(rows, model_vectors(spark, sf, dims).drop("label"), "emb-sides")


def emb_models(spark: SparkSession, sf: str):
    """(rows, query vectors, corpus vectors) with a vector column per model of MODELS."""
    rows = stage_table(emb_rows(spark, sf).drop("context_empty"), "emb-rows")
    e = table(spark, sf, "embeddings", spread_rows=True)
    vectors = e.select("vec_id", *[_folded(F.col("embedding"), d).alias(f"e{i}") for i, (_, d) in enumerate(MODELS)])
    return rows, *_emb_sides(rows, vectors, "emb-sides")
