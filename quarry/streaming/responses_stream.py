"""Test-set rows from generated responses arriving as files (C9 on a stream).

Responses (``entry_id, resp_id, response``) land in a folder as Parquet;
each micro-batch is split into query lines and joined to the static,
already parsed documents (a stream-static inner join), so the test set grows
as responses arrive. Failed or missing responses simply never produce rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.operators.ledger import RequestLedger
from quarry.operators.responses import parse_responses

RESPONSE_SCHEMA = "entry_id bigint, resp_id bigint, response string"


def responses_stream(spark: SparkSession, folder: str, schema: str = RESPONSE_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def test_set_stream(spark: SparkSession, folder: str, docs: DataFrame,
                    cfg: EvalConfig = DEFAULT_CONFIG) -> DataFrame:
    """Streaming test set: ``entry_id, resp_id, line_no, query, context``;
    ``docs`` is the static output of ``to_documents``."""
    return parse_responses(docs, responses_stream(spark, folder), cfg)


def start_ledger_sink(responses: DataFrame, ledger: RequestLedger, checkpoint_path: str, name: str = "stream",
                      available_now: bool = True) -> StreamingQuery:
    """Record arriving responses in the ledger, each micro-batch as a batch of its own: one
    that is done again after a failure replaces itself, so every answer counts once."""
    def record(rows: DataFrame, batch: int) -> None:
        ledger.record(rows, f"{name}-{batch}")

    w = responses.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
