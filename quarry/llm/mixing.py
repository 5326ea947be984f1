"""Mixing sources to target weights by capped water-filling.

Every source's target is its weight's share of the budget, clamped at
``max_epochs`` times its own size; what a clamp leaves over is shared out again
among the others by weight until no target is above its clamp. A source is
then sampled in whole repetitions of all its documents plus one fractional
repetition: the documents with the smallest seeded hashes, up to the hash at
which their running size comes nearest to the rest of the target.

Only one narrow pass over the documents, histogram counts (``cuts``) and a
table with one row per source are needed; documents are neither sorted nor
moved, and a source that holds most rows costs no more than its scan.

Defined results: a null source is a source of its own (last in order); a null
or empty text has size 0 and takes 0 words; rows with equal ids are taken or
left together; no rows give no rows; sources of size 0 have target 0. Other
columns of the input are ignored by ``mixture`` and kept by ``repeat_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rand import hash_int
from quarry.llm.common import small, word_count
from quarry.llm.cuts import PAST_END, weighted_cuts
from quarry.operators.ids import dense_index
from quarry.session import stage_table

SEED = "mix-1"


def draw_key(doc_id: Column, seed: str = SEED) -> Column:
    """The document's place in the seeded order (60 bits)."""
    return hash_int(seed, doc_id, digits=15)


def water_level(sources: DataFrame, budget: float) -> float:
    """The level L with sum(min(cap, L * weight)) = budget; infinite if the caps
    cannot hold the budget. ``sources``: ``cap, weight``; one small aggregate
    per clamping round."""
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("c"),
                          F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"),
                          F.sum(full.cast("int")).alias("n")).first()
        if row["n"] == clamped or row["n"] is None:
            return level
        if not row["w"]:
            return float("inf")
        clamped, level = row["n"], (budget - row["c"]) / row["w"]


def mixture(docs: DataFrame, weights: list[int], budget_ratio: float, max_epochs: int,
            seed: str = SEED) -> DataFrame:
    """The mixing plan, one row per source: ``m_source, m_weight, m_size, m_target,
    m_whole, m_cut``. A document of the source is repeated ``m_whole`` times, once
    more if its ``draw_key`` is below ``m_cut``. ``weights`` repeat over the sources
    in code point order, null last."""
    facts = stage_table(docs.select(F.col("source").alias("grp"), draw_key(F.col("doc_id"), seed).alias("key"),
                                    word_count(F.col("text")).alias("weight")), "mix-facts")
    totals = facts.groupBy("grp").agg(F.sum("weight").alias("size")).withColumn("last", F.col("grp").isNull())
    numbered = dense_index(totals, ["last", "grp"], out="pos")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = stage_table(numbered.select("grp", "size", weight.cast("bigint").alias("weight"),
                                          (F.col("size") * max_epochs).alias("cap")), "mix-sources")
    whole = sources.agg(F.sum("size")).first()[0] or 0
    level = water_level(sources, budget_ratio * whole)
    cap = F.col("cap").cast("double")
    target = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    reps = F.when(F.col("size") > 0, F.floor(F.col("goal") / F.col("size"))).otherwise(0)
    plan = (sources.withColumn("goal", target).withColumn("whole", reps.cast("bigint"))
            .withColumn("target", F.col("goal") - F.col("whole") * F.col("size")))
    plan = stage_table(plan, "mix-plan")
    cuts = weighted_cuts(facts, plan.select("grp", "target")).select(
        F.col("grp").alias("g"), "cut", "below", "atom")
    # the document at the cut is taken if that comes nearer to the target
    nearer = (F.col("atom") > 0) & (F.col("below") + F.col("atom") - F.col("target") <= F.col("target") - F.col("below"))
    cut = F.when(F.col("target") <= 0, 0).otherwise(F.col("cut") + nearer.cast("bigint"))
    return stage_table(plan.join(cuts, F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("grp").alias("m_source"), F.col("weight").alias("m_weight"), F.col("size").alias("m_size"),
        F.col("goal").alias("m_target"), F.col("whole").alias("m_whole"),
        F.least(cut, F.lit(PAST_END)).cast("bigint").alias("m_cut")), "mix-plan")


def with_repeats(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with the plan's columns of its source and ``m_repeats``."""
    more = draw_key(F.col("doc_id"), seed) < F.col("m_cut")
    return (docs.join(small(plan), docs["source"].eqNullSafe(plan["m_source"]))
            .withColumn("m_repeats", F.col("m_whole") + more.cast("bigint")))


def repeat_rows(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it."""
    cols = [docs[c] for c in docs.columns]
    drawn = with_repeats(docs, plan, seed).filter(F.col("m_repeats") > 0)
    return drawn.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), "m_repeats")).alias("m_copy")).drop("m_copy")
