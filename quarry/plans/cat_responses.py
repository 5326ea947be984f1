"""Catalogue: requests, response parsing, query clean-up, CSV round trip and
sample preview (C8-C10, B13-B15, A4, A5, A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import lower_first, normalise_context, strip_starters
from quarry.operators.ledger import RequestLedger
from quarry.operators.parse import to_documents
from quarry.operators.responses import failed_requests, render_requests
from quarry.plans.cat_training import _test_set
from quarry.plans.common import TEST_CFG, eval_set, tagged
from quarry.plans.registry import query
from quarry.plans.sqlfrag import (EVAL_SET_CTES, SEED, STARTERS_SQL, TAGGED, TEST_SET_CTES,
                                  clean_query_sql, hkey, parsed_cte, strip)
from quarry.session import scratch_dir
from quarry.sources.evalset_io import read_eval_csv, sample_preview, write_eval_csv
from quarry.sources.tables import table

_TPL = TEST_CFG.request_template
_PRE, _POST = _TPL.split("{prompt_text}")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("render_requests", sql=f"""
WITH {TAGGED}, {parsed_cte()}
SELECT entry_id, {_lit(_PRE)} || body || {_lit(_POST)} AS request FROM parsed""")
def render_requests_q(spark, sf):
    docs = to_documents(tagged(spark, sf), cfg=TEST_CFG)
    return render_requests(docs, TEST_CFG)


@query("parse_responses", sql=f"""
WITH {TEST_SET_CTES}
SELECT entry_id, resp_id, line_no, query, context FROM test_set""")
def parse_responses_q(spark, sf):
    return _test_set(spark, sf)


_USABLE = strip("replace(text, chr(10), '')") + " <> ''"


@query("failed_responses", sql=f"""
SELECT doc_id AS entry_id FROM documents
WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND text IS NOT NULL AND {_USABLE})""")
def failed_responses(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"))
    conv = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    resp = conv.select(F.col("conv_id").alias("entry_id"), F.col("text").alias("response"))
    return failed_requests(docs, resp)


# -- the ledger: every turn of a conversation is an attempt at the entry of its number; in
# turns divisible by 3 the service answers with blanks only, in those by 5 not at all

_ATTEMPTS = """
a AS (
  SELECT conv_id AS entry_id, turn AS attempt,
         CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 3 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS text,
         'answers-' || role AS batch FROM conversations),
u AS (SELECT *, coalesce(""" + _USABLE + """, false) AS ok FROM a)"""


def _ledger(spark, sf):
    """The attempts recorded by role, with every batch replayed."""
    c = table(spark, sf, "conversations")
    answer = F.when(F.col("turn") % 5 == 0, F.lit(None)).when(F.col("turn") % 3 == 0, F.lit(" \n\t")).otherwise(F.col("text"))
    rows = c.select(F.col("conv_id").alias("entry_id"), F.col("turn").alias("resp_id"), answer.alias("response"), "role")
    ledger = RequestLedger(spark, scratch_dir(spark, "ledger"))
    for role in ("assistant", "user", "assistant", "user"):
        ledger.record(rows.filter(F.col("role") == role).drop("role"), f"answers-{role}")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("entry_id"), "text")
    return ledger, docs


@query("ledger_status", sql=f"""
WITH {_ATTEMPTS}
SELECT d.doc_id AS entry_id, count(u.entry_id) AS attempts, count(*) FILTER (WHERE NOT u.ok) AS failed,
       count(*) FILTER (WHERE u.ok) > 0 AS answered
FROM documents d LEFT JOIN u ON u.entry_id = d.doc_id AND u.batch IN ('answers-assistant', 'answers-user') GROUP BY d.doc_id""")
def ledger_status(spark, sf):
    """Attempts of every request; blank-only answers are failures, replays count once."""
    ledger, docs = _ledger(spark, sf)
    return ledger.status(docs)


@query("ledger_answers", sql=f"""
WITH {_ATTEMPTS}
SELECT entry_id, max(attempt) AS resp_id, md5(arg_max(text, struct_pack(a := attempt, b := batch))) AS response_md5
FROM u WHERE ok AND batch IN ('answers-assistant', 'answers-user') GROUP BY entry_id""")
def ledger_answers(spark, sf):
    """The latest usable answer of every entry."""
    return _ledger(spark, sf)[0].answers().select("entry_id", "resp_id", F.md5("response").alias("response_md5"))


@query("ledger_open", sql=f"""
WITH {_ATTEMPTS}, {TAGGED}, {parsed_cte()}
SELECT entry_id, {_lit(_PRE)} || body || {_lit(_POST)} AS request FROM parsed
WHERE entry_id NOT IN (SELECT entry_id FROM u WHERE ok AND batch IN ('answers-assistant', 'answers-user'))""")
def ledger_open(spark, sf):
    """The requests still to be sent."""
    ledger, _ = _ledger(spark, sf)
    return ledger.open_requests(render_requests(to_documents(tagged(spark, sf), cfg=TEST_CFG), TEST_CFG))


# Starter-stripping inputs: every benchmark text prefixed with two starters,
# one pair in list order and one against it (indices derived from item_id).
N_ST = len(TEST_CFG.starters)
ST_CASES_SQL = f"""
st AS (SELECT {STARTERS_SQL} AS s),
cases AS (
  SELECT item_id, 0 AS variant,
         upper(s[(item_id % {N_ST}) + 1]) || ' ' || s[((item_id + 3) % {N_ST}) + 1] || ' ' || text AS q
  FROM benchmark, st
  UNION ALL
  SELECT item_id, 1, s[((item_id + 3) % {N_ST}) + 1] || '  ' || s[(item_id % {N_ST}) + 1] || ' ' || text
  FROM benchmark, st
  UNION ALL
  SELECT item_id, 2, s[(item_id % {N_ST}) + 1] FROM benchmark, st)"""


def _cases(spark, sf):
    b = table(spark, sf, "benchmark")
    st = F.array(*[F.lit(s.lower()) for s in TEST_CFG.starters])
    i1 = F.pmod(F.col("item_id"), F.lit(N_ST)).cast("int")
    i2 = F.pmod(F.col("item_id") + 3, F.lit(N_ST)).cast("int")
    a, c = F.get(st, i1), F.get(st, i2)
    v0 = b.select("item_id", F.lit(0).alias("variant"),
                  F.concat_ws(" ", F.upper(a), c, F.col("text")).alias("q"))
    v1 = b.select("item_id", F.lit(1).alias("variant"), F.concat(c, F.lit("  "), a, F.lit(" "),
                                                                 F.col("text")).alias("q"))
    v2 = b.select("item_id", F.lit(2).alias("variant"), a.alias("q"))
    return v0.unionByName(v1).unionByName(v2)


@query("strip_starters", sql=f"""
WITH {ST_CASES_SQL}
SELECT item_id, variant, list_reduce({STARTERS_SQL}, lambda acc, s: CASE WHEN starts_with(lower(acc), s)
       THEN {strip('substr(acc, length(s) + 1)')} ELSE acc END, q) AS stripped
FROM cases""")
def strip_starters_q(spark, sf):
    c = _cases(spark, sf)
    return c.select("item_id", "variant", strip_starters(F.col("q"), TEST_CFG.starters).alias("stripped"))


@query("lower_first", sql=f"""
WITH {ST_CASES_SQL}
SELECT item_id, variant, {clean_query_sql('q')} AS query FROM cases""")
def lower_first_q(spark, sf):
    c = _cases(spark, sf).withColumn("_s", strip_starters(F.col("q"), TEST_CFG.starters))
    return c.select("item_id", "variant", lower_first(F.col("_s")).alias("query"))


@query("normalise_context", sql="""
SELECT c.conv_id, c.turn, coalesce(d.text, '') AS context
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 10 + c.turn""")
def normalise_context_q(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("_k"), F.col("text").alias("_t"))
    j = c.join(d, F.col("conv_id") * 10 + F.col("turn") == F.col("_k"), "left")
    return j.select("conv_id", "turn", normalise_context(F.col("_t")).alias("context"))


@query("eval_csv_roundtrip", sql=f"""
WITH {EVAL_SET_CTES} SELECT query, context, relevance FROM eval_rows""")
def eval_csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "eval-csv")
    write_eval_csv(eval_set(spark, sf), path)
    return read_eval_csv(spark, path)


@query("sample_preview", sql=f"""
WITH {EVAL_SET_CTES}
SELECT row_id, query, relevance FROM eval_rows
ORDER BY {hkey([str(SEED), "'preview'", 'row_id'])}, row_id LIMIT 5""")
def sample_preview_q(spark, sf):
    return sample_preview(eval_set(spark, sf), 5, SEED).select("row_id", "query", "relevance")
