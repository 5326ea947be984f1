"""Generation requests out, generated responses in.

The external text-generation service is not called from Spark: requests are
written as a table, responses come back as a table keyed by the entry id,
and the join below turns them into a test set. Failed or missing responses
drop only their own entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.functions.text import lower_first, normalise_context, strip_starters, ustrip
from quarry.operators.querygen import render


def render_requests(docs: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG, id_col: str = "entry_id",
                    body_col: str = "page_content") -> DataFrame:
    """``entry_id, request``: the request template with the body filled in."""
    return docs.select(F.col(id_col).alias("entry_id"),
                       render(cfg.request_template, prompt_text=F.col(body_col)).alias("request"))


def clean_query(q, cfg: EvalConfig = DEFAULT_CONFIG):
    """Strip leading question phrases, then lower-case the first letter."""
    return lower_first(strip_starters(q, cfg.starters))


def usable(response):
    """Whether an answer has a line that is not blank; missing answers have none."""
    return F.coalesce(ustrip(F.regexp_replace(response, "\n", "")) != F.lit(""), F.lit(False))


def parse_responses(docs: DataFrame, responses: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG,
                    id_col: str = "entry_id", body_col: str = "page_content",
                    response_col: str = "response", resp_key: str = "resp_id",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Test set: one row per non-blank response line.

    Output: ``entry_id, resp_id, line_no, query, context`` (+ ``keep``). The
    response side is exploded before the join, so the join key is the entry
    id (one document row per key on the build side)."""
    lines = (responses.filter(F.col(response_col).isNotNull())
             .select(F.col(id_col).alias("entry_id"), F.col(resp_key).alias("resp_id"),
                     F.posexplode(F.split(F.col(response_col), "\n")).alias("line_no", "_raw"))
             .withColumn("_q", ustrip(F.col("_raw")))
             .filter(F.col("_q") != F.lit("")))
    d = docs.select(F.col(id_col).alias("entry_id"), F.col(body_col).alias("_ctx"), *keep)
    out = (lines.withColumn("_s", strip_starters(F.col("_q"), cfg.starters))
                .join(d, "entry_id"))
    return out.select("entry_id", "resp_id", F.col("line_no").cast("bigint").alias("line_no"),
                      lower_first(F.col("_s")).alias("query"),
                      normalise_context(F.col("_ctx")).alias("context"), *keep)


def failed_requests(docs: DataFrame, responses: DataFrame, id_col: str = "entry_id",
                    response_col: str = "response") -> DataFrame:
    """Entries without any usable response (anti-join): none, missing or blank ones only."""
    ok = responses.filter(usable(F.col(response_col))).select(F.col(id_col).alias("entry_id"))
    return docs.select(F.col(id_col).alias("entry_id")).join(ok, "entry_id", "left_anti")
