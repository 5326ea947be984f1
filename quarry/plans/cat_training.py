"""Catalogue: relevance filter, distinct contexts, negatives, training tuples,
mini-batches and the run manifest (B16, T1-T6, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.training import (TextStore, _augmented, _positives, distinct_contexts, mini_batches,
                                       run_manifest, sample_negatives, training_examples, training_keys,
                                       training_labelled, training_refs, tuple_texts)
from quarry.plans.common import TEST_CFG, eval_set
from quarry.plans.pipelines import build_training_set
from quarry.plans.registry import query
from quarry.plans.sqlfrag import (EVAL_SET_CTES, SEED, TEST_SET_CTES, alt_rows_cte,
                                  contexts_cte, hkey, parsed_cte, ring_offsets_sql)
from quarry.session import scratch_dir, stage_table
from quarry.sources.batches import read_batches, write_batches
from quarry.sources.reports import manifest_json, write_json
from quarry.sources.tables import table

SEP = " ||| "
RUN_STAMP = "2026-01-01 00:00:00"


@query("positive_filter", sql=f"""
WITH {EVAL_SET_CTES}
SELECT row_id, query, context FROM eval_rows WHERE relevance = 1.0""")
def positive_filter(spark, sf):
    return eval_set(spark, sf).filter(F.col("relevance") == 1.0).select("row_id", "query", "context")


DOC_ROWS = "doc_rows AS (SELECT doc_id AS row_id, text AS context FROM documents)"


@query("distinct_contexts", sql=f"""
WITH {DOC_ROWS}, {contexts_cte('doc_rows', 'row_id')}
SELECT ctx_id, first_row_id, n_rows, context FROM ctx""")
def distinct_contexts_q(spark, sf):
    rows = table(spark, sf, "documents", spread_rows=True).select(F.col("doc_id").alias("row_id"),
                                                F.col("text").alias("context"))
    c = distinct_contexts(rows)
    return c.select("ctx_id", F.col("row_id").alias("first_row_id"), "n_rows", "context")


def _neg_long_sql(src_cte: str, order: str, key: str, n: str, extra: str = "") -> str:
    return f"""
WITH {src_cte}, {contexts_cte('src', order)},
r AS (SELECT src.*, ctx.ctx_id AS p, ctx_n.c, {key} AS k
      FROM src JOIN ctx USING (context) CROSS JOIN ctx_n),
o AS (SELECT *, {ring_offsets_sql(n, 'c - 1', 'k')} AS offs FROM r),
negs AS (SELECT o.*, t.j, (p + 1 + offs[t.j + 1]) % c AS nid FROM o, unnest(range(len(offs))) AS t(j))
SELECT {order}, p AS pos_ctx_id, j::INTEGER AS j, nid AS neg_ctx_id, ctx.context AS negative
FROM negs JOIN ctx ON ctx.ctx_id = negs.nid {extra}"""


@query("negatives_strict", sql=_neg_long_sql(
    "src AS (SELECT doc_id AS row_id, text AS context FROM documents)", "row_id", "row_id", "3"))
def negatives_strict(spark, sf):
    rows = table(spark, sf, "documents", spread_rows=True).select(F.col("doc_id").alias("row_id"),
                                                F.col("text").alias("context"))
    s = sample_negatives(rows, distinct_contexts(rows), 3, "strict", SEED)
    return s.select("row_id", "pos_ctx_id",
                    F.posexplode(F.arrays_zip(F.col("neg_ids").alias("neg_ctx_id"),
                                              F.col("negatives").alias("negative")))
                    .alias("j", "z")).select("row_id", "pos_ctx_id", "j", "z.neg_ctx_id", "z.negative")


def _test_set(spark, sf):
    from quarry.operators.parse import to_documents
    from quarry.operators.responses import parse_responses
    from quarry.plans.common import tagged
    docs = to_documents(tagged(spark, sf), cfg=TEST_CFG)
    conv = table(spark, sf, "conversations", spread_rows=True).filter(F.col("role") == "assistant")
    resp = conv.select(F.col("conv_id").alias("entry_id"), F.col("turn").alias("resp_id"),
                       F.col("text").alias("response"))
    return parse_responses(docs, resp, TEST_CFG)


TS_ORDER = "entry_id, resp_id, line_no"
TS_KEY = "concat_ws('|', entry_id, resp_id, line_no)"


@query("negatives_capped", sql=_neg_long_sql(
    f"{TEST_SET_CTES}, src AS (SELECT * FROM test_set WHERE context <> '')",
    TS_ORDER, TS_KEY, "least(3, c - 1)"))
def negatives_capped(spark, sf):
    ts = _test_set(spark, sf).filter(F.col("context") != "")
    order = ["entry_id", "resp_id", "line_no"]
    ctx = distinct_contexts(ts, order_cols=order)
    ts = ts.withColumn("_k", F.concat_ws("|", *[F.col(c).cast("string") for c in order]))
    s = sample_negatives(ts, ctx, 3, "capped", SEED, key_col="_k")
    return s.select(*order, "pos_ctx_id",
                    F.posexplode(F.arrays_zip(F.col("neg_ids").alias("neg_ctx_id"),
                                              F.col("negatives").alias("negative")))
                    .alias("j", "z")).select(*order, "pos_ctx_id", "j", "z.neg_ctx_id", "z.negative")


TRAIN_CTES = f"""{EVAL_SET_CTES},
src AS (SELECT row_id, query, context, relevance FROM eval_rows),
{contexts_cte('src', 'row_id')},
pos AS (SELECT src.row_id, src.query, src.context, ctx.ctx_id AS p, ctx_n.c
        FROM src JOIN ctx USING (context) CROSS JOIN ctx_n WHERE src.relevance = 1.0),
o AS (SELECT *, {ring_offsets_sql('3', 'c - 1', 'row_id')} AS offs FROM pos),
negs AS (SELECT o.row_id, string_agg(ctx.context, '{SEP}' ORDER BY t.j) AS negatives
         FROM o, unnest(range(len(offs))) AS t(j)
         JOIN ctx ON ctx.ctx_id = (o.p + 1 + o.offs[t.j + 1]) % o.c
         GROUP BY o.row_id),
ptext AS (SELECT row_id, context AS text FROM pos),
{parsed_cte(src='ptext', dedup=True, name='pp')},
{alt_rows_cte('pp', 'row_id')},
tuples AS (
  SELECT pos.row_id, 0 AS aug_pos, pos.query, pos.context AS positive, negs.negatives
  FROM pos JOIN negs USING (row_id)
  UNION ALL
  SELECT pos.row_id, a.aug_pos, a.query, pos.context, negs.negatives
  FROM pos JOIN negs USING (row_id) JOIN alt_rows a ON a.akey = pos.row_id)"""


@query("training_examples", sql=f"""
WITH {TRAIN_CTES}
SELECT row_id, aug_pos, query, positive, negatives, 0.0::DOUBLE AS label, aug_pos > 0 AS augmented
FROM tuples""")
def training_examples_q(spark, sf):
    t = training_examples(eval_set(spark, sf), 3, TEST_CFG)
    return t.select("row_id", "aug_pos", "query", "positive",
                    F.array_join("negatives", SEP).alias("negatives"), "label", "augmented")


_KEY = "substr(sha256({}), 1, 32)"
_REF_NEGS = f"""
rn AS (SELECT o.row_id, string_agg({_KEY.format('ctx.context')}, ',' ORDER BY t.j) AS negative_keys
       FROM o, unnest(range(len(offs))) AS t(j) JOIN ctx ON ctx.ctx_id = (o.p + 1 + o.offs[t.j + 1]) % o.c GROUP BY o.row_id)"""


@query("training_refs", sql=f"""
WITH {TRAIN_CTES}, {_REF_NEGS}
SELECT row_id, aug_pos, query, {_KEY.format('positive')} AS positive_key, negative_keys, 0.0::DOUBLE AS label,
       aug_pos > 0 AS augmented FROM tuples JOIN rn USING (row_id)""")
def training_refs_q(spark, sf):
    """T4 by reference: the tuples with keys in the place of texts."""
    t, _ = training_refs(eval_set(spark, sf), 3, TEST_CFG)
    return t.withColumn("negative_keys", F.array_join("negative_keys", ","))


@query("training_texts", sql=f"""
WITH {TRAIN_CTES}
SELECT row_id, 0 AS slot, md5(context) AS text_md5 FROM pos
UNION ALL
SELECT o.row_id, (t.j + 1)::INTEGER, md5(ctx.context)
FROM o, unnest(range(len(offs))) AS t(j) JOIN ctx ON ctx.ctx_id = (o.p + 1 + o.offs[t.j + 1]) % o.c""")
def training_texts(spark, sf):
    """T4: the texts of the referenced tuples, joined bucket by bucket."""
    t, texts = training_refs(eval_set(spark, sf), 3, TEST_CFG)
    return tuple_texts(t, TextStore(texts)).select("row_id", "slot", F.md5("text").alias("text_md5"))


@query("training_labelled", sql=f"""
WITH {TEST_SET_CTES}, src AS (SELECT * FROM test_set WHERE context <> ''),
{contexts_cte('src', TS_ORDER)},
r AS (SELECT src.*, ctx.ctx_id AS p, ctx_n.c, {TS_KEY} AS k
      FROM src JOIN ctx USING (context) CROSS JOIN ctx_n),
o AS (SELECT *, {ring_offsets_sql('least(3, c - 1)', 'c - 1', 'k')} AS offs FROM r),
negs AS (SELECT o.k, string_agg(ctx.context, '{SEP}' ORDER BY t.j) AS negatives
         FROM o, unnest(range(len(offs))) AS t(j)
         JOIN ctx ON ctx.ctx_id = (o.p + 1 + o.offs[t.j + 1]) % o.c GROUP BY o.k)
SELECT o.entry_id, o.resp_id, o.line_no, o.query, o.context AS positive,
       coalesce(negs.negatives, '') AS negatives, 1.0::DOUBLE AS label
FROM o LEFT JOIN negs USING (k)""")
def training_labelled_q(spark, sf):
    t = training_labelled(_test_set(spark, sf), ("entry_id", "resp_id", "line_no"), 3, TEST_CFG)
    return t.select("entry_id", "resp_id", "line_no", "query", "positive",
                    F.array_join("negatives", SEP).alias("negatives"), "label")


@query("mini_batches", sql=f"""
WITH {TRAIN_CTES},
e AS (SELECT row_id, aug_pos, epoch,
             {hkey([str(SEED), "'batch'", 'epoch', "concat_ws('|', row_id, aug_pos)"])} AS h
      FROM tuples, (SELECT unnest(range(2)) AS epoch))
SELECT row_id, aug_pos, epoch::INTEGER AS epoch,
       row_number() OVER (PARTITION BY epoch ORDER BY h, row_id, aug_pos) - 1 AS position,
       (row_number() OVER (PARTITION BY epoch ORDER BY h, row_id, aug_pos) - 1) // 16 AS batch_id
FROM e""")
def mini_batches_q(spark, sf):
    keys = stage_table(training_keys(eval_set(spark, sf), TEST_CFG), "tuple-keys")
    return mini_batches(keys, ["row_id", "aug_pos"], batch_size=16, epochs=2, seed=SEED)


BATCHES_PER_FILE = 10


@query("batch_files", sql=f"""
WITH {TRAIN_CTES},
e AS (SELECT row_id, aug_pos, query, epoch,
             {hkey([str(SEED), "'batch'", 'epoch', "concat_ws('|', row_id, aug_pos)"])} AS h
      FROM tuples, (SELECT unnest(range(2)) AS epoch)),
b AS (SELECT *, (row_number() OVER (PARTITION BY epoch ORDER BY h, row_id, aug_pos) - 1) // 16 AS batch_id FROM e)
SELECT epoch::INTEGER AS epoch, batch_id, count(*) AS n_rows, 1::BIGINT AS n_files,
       md5(string_agg(query, '|' ORDER BY row_id, aug_pos)) AS queries_md5
FROM b GROUP BY epoch, batch_id""")
def batch_files(spark, sf):
    """Batches with their queries written by range and read back; each lies in one file."""
    keyed = stage_table(_augmented(_positives(eval_set(spark, sf)), TEST_CFG).select("row_id", "aug_pos", "query"), "tuple-queries")
    batches = mini_batches(keyed.select("row_id", "aug_pos"), ["row_id", "aug_pos"], batch_size=16, epochs=2, seed=SEED)
    path = scratch_dir(spark, "batches")
    write_batches(batches.join(keyed, ["row_id", "aug_pos"]), path, BATCHES_PER_FILE)
    said = F.transform(F.sort_array(F.collect_list(F.struct("row_id", "aug_pos", "query"))), lambda x: x["query"])
    return read_batches(spark, path).withColumn("_f", F.input_file_name()).groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_f").alias("n_files"), F.md5(F.array_join(said, "|")).alias("queries_md5"))


@query("training_set", sql=f"""
WITH {TRAIN_CTES},
e AS (SELECT row_id, aug_pos, query, md5(positive) AS positive_md5, md5(negatives) AS negatives_md5, epoch,
             {hkey([str(SEED), "'batch'", 'epoch', "concat_ws('|', row_id, aug_pos)"])} AS h
      FROM tuples, (SELECT unnest(range(3)) AS epoch))
SELECT row_id, aug_pos, query, positive_md5, negatives_md5, epoch::INTEGER AS epoch,
       (row_number() OVER (PARTITION BY epoch ORDER BY h, row_id, aug_pos) - 1) // 16 AS batch_id
FROM e""")
def training_set_q(spark, sf):
    """The tuples in their batches."""
    t = build_training_set(eval_set(spark, sf), TEST_CFG, epochs=3)
    tuples = t["tuples"].select("row_id", "aug_pos", "query", F.md5("positive").alias("positive_md5"),
                                F.md5(F.array_join("negatives", SEP)).alias("negatives_md5"))
    return (t["batches"].join(tuples, ["row_id", "aug_pos"])
            .select("row_id", "aug_pos", "query", "positive_md5", "negatives_md5", "epoch", "batch_id"))


@query("run_manifest", sql=f"""
WITH {TRAIN_CTES}
SELECT 'base' AS base_model, 3 AS epochs, 16 AS batch_size, 2e-5::DOUBLE AS learning_rate,
       count(*) AS training_examples, ceil(count(*) / 16)::BIGINT AS batches_per_epoch,
       floor(ceil(count(*) / 16) * 0.1)::BIGINT AS warmup_steps, '{RUN_STAMP}' AS timestamp
FROM tuples""")
def run_manifest_q(spark, sf):
    """The run record, written as JSON and read back."""
    keys = training_keys(eval_set(spark, sf), TEST_CFG)
    record = run_manifest(keys, "base", epochs=3, batch_size=16, learning_rate=2e-5, generated_at=RUN_STAMP)
    path = scratch_dir(spark, "manifest")
    write_json(manifest_json(record), path)
    return spark.read.schema(record.schema).json(path)
