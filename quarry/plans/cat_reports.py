"""Catalogue: text encoder, end-to-end text pipelines and reports.

The pipelines are checked against DuckDB end to end (the oracle rebuilds the
hash-encoder vectors in SQL). Report numbers are rounded before they are
formatted, so both engines print the same digits; JSON documents are read back
and compared value by value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators.encode import HashEncoder, IsolatingEncoder, embed, hash_vectors, index_texts
from quarry.operators.vector_index import VectorIndex
from quarry.plans.cat_training import _test_set
from quarry.plans.common import TEST_CFG, eval_set
from quarry.plans.pipelines import compare_models, compare_paired, leaderboard
from quarry.plans.registry import query
from quarry.plans.sqlfrag import (EVAL_SET_CTES, TEST_SET_CTES, SEED, cos_sql, h, hash_vec_cte,
                                  text_index_ctes, text_model_ctes)
from quarry.plans.cat_metrics import _multi_sql, _rowwise_sql
from quarry import config as C
from quarry.config import DEFAULT_CONFIG, EXAMPLE_QUERIES
from quarry.operators.metrics import METRIC_COLS, METRICS
from quarry.sources.reports import (comparison_json, comparison_report, leaderboard_report,
                                    result_json, write_json, write_rows)
from quarry.session import scratch_dir
from quarry.sources.tables import table

TEXT_MODELS = {"hash64": HashEncoder(64, 1), "hash32": HashEncoder(32, 2)}
TEXT_DIMS = (("hash64", 64, 1, "h64_"), ("hash32", 32, 2, "h32_"))


def _r(cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def _rs(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


EV = f"""{EVAL_SET_CTES},
ev AS (SELECT row_id, query, context, relevance FROM eval_rows),
{text_index_ctes()}"""

BOARD_SQL = "WITH " + EV + ",\n" + ",\n".join(
    f"{text_model_ctes(p, d, sd)},\n{_rowwise_sql(p)}" for _, d, sd, p in TEXT_DIMS) + """,
board AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS model, {i} AS model_pos, "
    + ", ".join(f"avg({c}) AS {c}" for c in METRIC_COLS) + f", count(*) AS n_rows FROM {p}m"
    for i, (n, _, _, p) in enumerate(TEXT_DIMS)) + ")"
RUN_STAMP = "2026-01-01 00:00:00"


@query("hash_embed", sql=f"""
WITH docs AS (SELECT text, min(doc_id) AS ctx_id FROM documents GROUP BY text),
{hash_vec_cte('hv', 'docs', 'ctx_id', 'text', 64, 1)}
SELECT vid AS ctx_id, len(v) AS dim, len(list_filter(v, lambda x: x <> 0)) AS nnz,
       round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1,
       array_to_string(list_transform(v, lambda x: x::BIGINT), ',') AS vector
FROM hv""")
def hash_embed(spark, sf):
    """Distinct document texts encoded once: the vectors (whole numbers) and
    their statistics."""
    docs = table(spark, sf, "documents", spread_rows=True).select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("context"))
    ix = index_texts(docs, "context", "ctx_id")
    v = embed(ix, "ctx_id", TEXT_MODELS["hash64"])
    return v.select("ctx_id", F.size("embedding").cast("bigint").alias("dim"),
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("nnz"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"),
                    F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",")
                     .alias("vector"))


def _p2(spark, sf):
    return leaderboard(eval_set(spark, sf), TEXT_MODELS)


@query("text_leaderboard", sql=f"""{BOARD_SQL}
SELECT model, model_pos, {_rs(METRIC_COLS)}, n_rows FROM board""")
def text_leaderboard(spark, sf):
    """P2 on the template eval set with two hash encoders."""
    b = _p2(spark, sf)["board"]
    return b.select("model", "model_pos", *_r(METRIC_COLS), "n_rows")


@query("indexed_leaderboard", sql=f"""{BOARD_SQL}
SELECT model, model_pos, {_rs(METRIC_COLS)}, n_rows FROM board""")
def indexed_leaderboard(spark, sf):
    """P2 with a kept vector index that already holds some of the contexts."""
    index = VectorIndex(spark, scratch_dir(spark, "index"))
    ev = eval_set(spark, sf)
    index.update(ev.filter(F.col("kind") == "genre").select(F.col("context").alias("text")), TEXT_MODELS)
    return leaderboard(ev, TEXT_MODELS, index=index)["board"].select("model", "model_pos", *_r(METRIC_COLS), "n_rows")


def _examples_ctes() -> str:
    ex = "ex(query_id, text) AS (VALUES " + ", ".join(
        f"({i}, '{q}')" for i, q in enumerate(EXAMPLE_QUERIES)) + ")"
    parts = []
    for n, d, sd, p in TEXT_DIMS:
        parts.append(f"""{hash_vec_cte(p + 'ex', 'ex', 'query_id', 'text', d, sd)},
{p}exr AS (
  SELECT '{n}' AS model, e.vid AS query_id, c.vid AS ctx_id, {cos_sql('e.v', 'c.v')} AS score
  FROM {p}ex e CROSS JOIN {p}cv c)""")
    hits = "\nUNION ALL\n".join(f"SELECT * FROM {p}exr" for _, _, _, p in TEXT_DIMS)
    return f"""{BOARD_SQL},
{ex},
{",\n".join(parts)},
best AS (SELECT * FROM board ORDER BY mrr DESC, model_pos LIMIT 1),
hits AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, ctx_id) AS rank
         FROM ({hits})),
examples AS (
  SELECT hits.model, hits.query_id::BIGINT AS query_id, ex.text AS query, hits.rank::INTEGER AS rank, hits.ctx_id,
         hits.score, ci.text AS context
  FROM hits JOIN best USING (model) JOIN ex USING (query_id) JOIN ci USING (ctx_id) WHERE rank <= 3),
comp AS (SELECT count(*) AS total, count(*) FILTER (WHERE relevance = 1.0) AS pos,
                count(*) FILTER (WHERE relevance = 0.0) AS neg FROM ev)"""


EXAMPLES = _examples_ctes()


def _f(c: str, digits: int = 3) -> str:
    return f"printf('%.{digits}f', round({c}, {digits}) + 0.0)"


def _text_lines(section: int, texts: list[str]) -> list[str]:
    return [f"SELECT {section} AS section, {i}::BIGINT AS line_no, '{t}' AS text" for i, t in enumerate(texts)]


def _report_sql() -> str:
    cols = [_f(c) for c in METRIC_COLS]
    parts = _text_lines(0, C.LEADERBOARD_HEAD)
    parts += _text_lines(2, C.LEADERBOARD_TABLE)
    parts.append(f"""SELECT 1, 0, '- Total examples: ' || total || '
- Evaluation date: {RUN_STAMP}
- Dataset composition: {{''positive_examples'': ' || pos || ', ''negative_examples'': ' || neg || '}}' FROM comp""")
    parts.append("SELECT 3, model_pos, '| ' || concat_ws(' | ', model, " + ", ".join(cols) + ") || ' |' FROM board")
    parts.append(f"""SELECT 4, 0, '
## Selected Model: ' || model || '

### Selection Rationale
1. **Best Overall Performance**: ' || model || ' achieved the highest Mean Reciprocal Rank (MRR) of ' || {_f('mrr')} || '.
2. **Precision**: P@1 ' || {_f('p_at_1')} || ', P@3 ' || {_f('p_at_3')} || ', P@5 ' || {_f('p_at_5')} || '
3. **NDCG@5**: ' || {_f('ndcg_at_5')} || '

### Example Queries and Results' FROM best""")
    parts.append("""SELECT DISTINCT 5, query_id << 32, '
#### Query: "' || query || '"' FROM examples""")
    parts.append(f"""SELECT 5, (query_id << 32) + rank, '
' || rank || '. **Score: ' || {_f('score')} || '**
   ```
   ' || context || '
   ```' FROM examples""")
    return f"{EXAMPLES}\n" + "\nUNION ALL\n".join(parts)


def _result_sql() -> str:
    parts = [f"SELECT 'timestamp' AS path, NULL::DOUBLE AS num, '{RUN_STAMP}' AS text"]
    parts += [f"SELECT 'dataset_info.{n}', {c}::DOUBLE, NULL FROM comp" for n, c in
              (("total_examples", "total"), ("positive_examples", "pos"), ("negative_examples", "neg"))]
    parts += [f"SELECT 'model_metrics.' || model || '.{m}', round({c}, 6), NULL FROM board"
              for c, m in zip(METRIC_COLS, METRICS)]
    parts.append("SELECT 'example_queries.' || query || '.' || rank, round(score, 6), context FROM examples")
    return f"{EXAMPLES}\n" + "\nUNION ALL\n".join(parts)


@query("text_examples", sql=f"""{EXAMPLES}
SELECT model, query_id, query, rank, ctx_id, round(score, 6) AS score FROM examples""")
def text_examples(spark, sf):
    r = _p2(spark, sf)["examples"]
    return r.select("model", "query_id", "query", "rank", "ctx_id", F.round("score", 6).alias("score"))


@query("report_lines", sql=_report_sql())
def report_lines(spark, sf):
    r = _p2(spark, sf)
    return leaderboard_report(r["board"], r["best"], r["examples"], r["composition"], RUN_STAMP)


RESULT_SCHEMA = """timestamp string,
dataset_info struct<total_examples:bigint,composition:struct<positive_examples:bigint,negative_examples:bigint>>,
model_metrics map<string,map<string,double>>,
example_queries array<struct<query:string,results:array<struct<rank:int,score:double,prompt:string>>>>"""


def _fact(path, num, text=None):
    return [path.alias("path"), num.cast("double").alias("num"),
            (F.lit(None) if text is None else text).cast("string").alias("text")]


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("result_json", sql=_result_sql())
def result_json_q(spark, sf):
    """The document, written and read back, as one row per value."""
    r = _p2(spark, sf)
    path = scratch_dir(spark, "result-json")
    write_json(result_json(r["board"], r["examples"], r["composition"], RUN_STAMP), path)
    doc = spark.read.schema(RESULT_SCHEMA).json(path)
    info = F.col("dataset_info")
    counts = {"total_examples": info["total_examples"],
              "positive_examples": info["composition"]["positive_examples"],
              "negative_examples": info["composition"]["negative_examples"]}
    models = (doc.select(F.explode("model_metrics").alias("model", "m"))
              .select("model", F.explode("m").alias("metric", "value")))
    hits = (doc.select(F.explode("example_queries").alias("e"))
            .select("e.query", F.explode("e.results").alias("h")))
    return _union([
        doc.select(*_fact(F.lit("timestamp"), F.lit(None), F.col("timestamp"))),
        *[doc.select(*_fact(F.lit(f"dataset_info.{n}"), c)) for n, c in counts.items()],
        models.select(*_fact(F.concat_ws(".", F.lit("model_metrics"), "model", "metric"), F.round("value", 6))),
        hits.select(*_fact(F.concat_ws(".", F.lit("example_queries"), "query", F.col("h.rank").cast("string")),
                           F.round("h.score", 6), F.col("h.prompt")))])


IMPR = ("base", "candidate", "absolute", "relative")


def _impr_ctes(long_cte: str) -> str:
    return f"""{long_cte},
means AS (SELECT model, metric, min(metric_pos) AS metric_pos, avg(value) AS value FROM long GROUP BY ALL),
impr AS (
  SELECT b.metric, b.metric_pos, b.value AS base, c.value AS candidate, c.value - b.value AS absolute,
         CASE WHEN b.value <> 0 THEN (c.value - b.value) / b.value * 100 ELSE 0.0 END AS relative
  FROM means b JOIN means c ON b.metric = c.metric AND b.model = 'base' AND c.model = 'candidate')"""


def _impr_sql(long_cte: str) -> str:
    return f"{_impr_ctes(long_cte)}\nSELECT metric, metric_pos, {_rs(IMPR)} FROM impr"


def _compare_models_sql() -> str:
    models = (("base", 32, 2, "cb_"), ("candidate", 64, 1, "cc_"))
    ctes = ",\n".join(f"{text_model_ctes(p, d, sd, 'dot')},\n{_multi_sql(p)}" for _, d, sd, p in models)
    longs = []
    for n, _, _, p in models:
        for i, (c, m) in enumerate(zip(METRIC_COLS, METRICS)):
            longs.append(f"SELECT '{n}' AS model, '{m}' AS metric, {i} AS metric_pos, "
                         f"sum({c} * weight) / sum(weight) AS value FROM {p}mq")
    return _impr_sql(f"WITH {EV},\n{ctes},\nlong AS (" + "\nUNION ALL\n".join(longs) + ")")


COMPARE_MODELS_SQL = _compare_models_sql()


@query("compare_models", sql=COMPARE_MODELS_SQL)
def compare_models_q(spark, sf):
    """P3 evaluation: multi-relevant metrics, base vs candidate encoder."""
    i = compare_models(eval_set(spark, sf), TEXT_MODELS["hash32"], TEXT_MODELS["hash64"])
    return i.select("metric", "metric_pos", *_r(IMPR))


def _p4(spark, sf):
    return compare_paired(_test_set(spark, sf), TEXT_MODELS["hash32"], TEXT_MODELS["hash64"], TEST_CFG)


def _paired_ctes() -> str:
    models = (("base", 32, 2, "pb_"), ("candidate", 64, 1, "pc_"))
    ctes = [f"""tsr AS (
  SELECT concat_ws('|', entry_id, resp_id, line_no) AS row_id, query, context, context = '' AS context_empty
  FROM test_set),
qt AS (SELECT DISTINCT query AS text FROM tsr),
ct AS (SELECT DISTINCT context AS text FROM tsr WHERE NOT context_empty)"""]
    sims = []
    for n, d, sd, p in models:
        ctes.append(hash_vec_cte(p + "q", "qt", "text", "text", d, sd))
        ctes.append(hash_vec_cte(p + "c", "ct", "text", "text", d, sd))
        sims.append(f"""SELECT '{n}' AS model, r.row_id, r.context_empty,
       CASE WHEN c.v IS NULL THEN 0.0 ELSE {cos_sql('q.v', 'c.v')} END AS s
  FROM tsr r JOIN {p}q q ON q.vid = r.query LEFT JOIN {p}c c ON c.vid = r.context""")
    longs = ["SELECT model, row_id, 'similarity' AS metric, 0 AS metric_pos, "
             "CASE WHEN context_empty THEN 0.0 ELSE s END AS value FROM sim"]
    for i, (name, scale, width) in enumerate(DEFAULT_CONFIG.simulated, start=1):
        u = f"({h([str(SEED), 'model', 'row_id', repr(name)])})::DOUBLE / 4294967296.0"
        longs.append(
            f"SELECT model, row_id, '{name}', {i}, CASE WHEN context_empty THEN 0.0 ELSE "
            f"greatest(0.0, least(1.0, s * {scale}::DOUBLE + (({u}) * 2 - 1) * {width}::DOUBLE)) END FROM sim")
    return (f"WITH {TEST_SET_CTES},\n" + ",\n".join(ctes) + ",\nsim AS ("
            + "\nUNION ALL\n".join(sims) + "),\nlong AS (" + "\nUNION ALL\n".join(longs) + ")")


PAIRED = _paired_ctes()
PAIRED_IMPR = _impr_ctes(PAIRED)


def _comparison_sql() -> str:
    parts = _text_lines(0, [C.COMPARISON_HEAD, "", f"Generated on: {RUN_STAMP}", "",
                            "## Model Details", "- Base Model: `hash32`", "- Finetuned Model: `hash64`", ""])
    parts += _text_lines(1, [f"## {C.COMPARISON_TITLE}", "", *C.COMPARISON_TABLE])
    parts += _text_lines(3, C.ANALYSIS_HEAD)
    b, c, d, r = _f("base"), _f("candidate"), _f("absolute"), _f("relative", 1)
    parts.append(f"""SELECT 2, metric_pos, '| ' || concat_ws(' | ', metric, {b}, {c}, {d}, {r} || '%') || ' |' FROM impr""")
    parts.append(f"""SELECT 4, 0, CASE WHEN count(*) = 0 THEN '{C.NO_RELATIVE_TEXT}' ELSE '- Highest relative improvement in **' || first(metric) || '**: ' || first({r}) || '%' END
FROM (SELECT * FROM impr WHERE base <> 0 ORDER BY relative DESC, metric_pos LIMIT 1)""")
    parts.append(f"""SELECT 5, 0, '
### Simulated Faithfulness Analysis
- Base model ' || metric || ': ' || {b} || '
- Finetuned model ' || metric || ': ' || {c} || '
- Absolute improvement: ' || {d} || '
- Relative improvement: ' || {r} || '%' FROM impr WHERE metric = 'simulated_faithfulness'""")
    return f"{PAIRED_IMPR}\n" + "\nUNION ALL\n".join(parts)


@query("compare_paired", sql=_impr_sql(PAIRED))
def compare_paired_q(spark, sf):
    """P4 evaluation: simulated metrics, base vs candidate encoder."""
    return _p4(spark, sf)["improvement"].select("metric", "metric_pos", *_r(IMPR))


@query("comparison_rows", sql=f"""{PAIRED}
SELECT model, row_id, metric, round(value, 6) AS value FROM long""")
def comparison_rows_q(spark, sf):
    """The per-row metric values, written by model and read back."""
    path = scratch_dir(spark, "comparison-rows")
    write_rows(_p4(spark, sf)["per_row"], path)
    return spark.read.parquet(path).select("model", "row_id", "metric", F.round("value", 6).alias("value"))


@query("comparison_report", sql=_comparison_sql())
def comparison_report_q(spark, sf):
    r = _p4(spark, sf)
    return comparison_report(r["improvement"], r["best_metric"], r["faithfulness"], "hash32", "hash64",
                             RUN_STAMP)


COMPARISON_SCHEMA = """timestamp string, base_model string, finetuned_model string,
metrics map<string,struct<base:double,finetuned:double,absolute:double,relative:double>>"""


@query("comparison_json", sql=f"{PAIRED_IMPR}\n" + "\nUNION ALL\n".join(
    [f"SELECT '{n}' AS path, NULL::DOUBLE AS num, '{v}' AS text" for n, v in (
        ("timestamp", RUN_STAMP), ("base_model", "hash32"), ("finetuned_model", "hash64"))]
    + [f"SELECT 'metrics.' || metric || '.{n}', round({c}, 6), NULL FROM impr" for n, c in (
        ("base", "base"), ("finetuned", "candidate"), ("absolute", "absolute"), ("relative", "relative"))]))
def comparison_json_q(spark, sf):
    """The document, written and read back, as one row per value."""
    path = scratch_dir(spark, "comparison-json")
    write_json(comparison_json(_p4(spark, sf)["improvement"], "hash32", "hash64", RUN_STAMP), path)
    doc = spark.read.schema(COMPARISON_SCHEMA).json(path)
    per = doc.select(F.explode("metrics").alias("metric", "v"))
    return _union(
        [doc.select(*_fact(F.lit(n), F.lit(None), F.col(n))) for n in ("timestamp", "base_model", "finetuned_model")]
        + [per.select(*_fact(F.concat_ws(".", F.lit("metrics"), "metric", F.lit(n)), F.round(F.col(f"v.{n}"), 6)))
           for n in ("base", "finetuned", "absolute", "relative")])


# an encoder that fails on every text with the marker: a plain function over batches
FAIL_MARK = "tionth"


def _failing_hash64(texts):
    if any(FAIL_MARK in t for t in texts):
        raise ValueError(f"cannot read {FAIL_MARK}")
    return hash_vectors(texts, 64, 1)


def _p4_failing(spark, sf):
    return compare_paired(_test_set(spark, sf), TEXT_MODELS["hash32"], IsolatingEncoder(_failing_hash64, 64), TEST_CFG)


_FAILED = f"contains(r.query, '{FAIL_MARK}') OR contains(r.context, '{FAIL_MARK}')"


@query("paired_errors", sql=f"""{PAIRED}
SELECT sim.model, row_id, round(CASE WHEN context_empty OR (model = 'candidate' AND ({_FAILED.replace('r.', 't.')})) THEN 0.0
       ELSE s END, 6) AS similarity, model = 'candidate' AND ({_FAILED.replace('r.', 't.')}) AS failed
FROM sim JOIN tsr t USING (row_id)""".replace("context_empty OR", "sim.context_empty OR"))
def paired_errors(spark, sf):
    """A text on which the encoder fails gives a similarity of 0 to its own rows only."""
    return _p4_failing(spark, sf)["pairs"].select("model", "row_id", F.round("similarity", 6).alias("similarity"), "failed")


@query("encode_errors", sql=f"""WITH {TEST_SET_CTES},
t AS (SELECT DISTINCT 'query' AS side, query AS text FROM test_set
      UNION ALL SELECT DISTINCT 'context', context FROM test_set WHERE context <> '')
SELECT 'candidate' AS model, side, 'ValueError' AS error, count(*) AS texts FROM t WHERE contains(text, '{FAIL_MARK}')
GROUP BY side""")
def encode_errors_q(spark, sf):
    """The texts on which a model failed, counted."""
    return _p4_failing(spark, sf)["errors"].select("model", "side", "error", "texts")
