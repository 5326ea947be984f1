"""Ledger of generation requests (C8, C10, P4): which entries were asked, how often, and
what the latest usable answer is.

Answers arrive in named batches (a response file, a micro-batch). A batch is one
partition of the ledger and is replaced as a whole when it is recorded again, so a replay
changes nothing. An answer is usable if a line of it is not blank; missing and blank-only answers are
failed attempts. The latest usable attempt wins, by attempt number, then by batch name; both
are partial aggregates, so an entry with very many attempts is combined map-side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.responses import usable

SCHEMA = "entry_id bigint, attempt bigint, response string, usable boolean, batch string"
_BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class RequestLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, responses: DataFrame, batch: str, attempt_col: str = "resp_id", response_col: str = "response") -> None:
        """Add a batch of answers (``entry_id, <attempt_col>, <response_col>``), or put it in the
        place of the batch of this name. An empty batch leaves the ledger as it is."""
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"batch names are letters, digits, '_', '.', '-': {batch!r}")
        rows = responses.select(F.col("entry_id").cast("bigint").alias("entry_id"), F.col(attempt_col).cast("bigint").alias("attempt"),
                                F.col(response_col).alias("response"), usable(F.col(response_col)).alias("usable"),
                                F.lit(batch).alias("batch"))
        # only the partitions that are written are replaced
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def attempts(self) -> DataFrame:
        """All attempts: ``entry_id, attempt, response, usable, batch``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)  # noqa: SLF001
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):  # noqa: SLF001
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def answers(self) -> DataFrame:
        """``entry_id, resp_id, response`` of the latest usable attempt of each entry."""
        last = F.max_by(F.struct("attempt", "response"), F.struct("attempt", "batch"))
        return (self.attempts().filter("usable").groupBy("entry_id").agg(last.alias("_a"))
                .select("entry_id", F.col("_a.attempt").alias("resp_id"), F.col("_a.response").alias("response")))

    def status(self, requests: DataFrame) -> DataFrame:
        """``entry_id, attempts, failed, answered`` of every entry of ``requests``."""
        per = self.attempts().groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("usable")).alias("_f"))
        n, f = F.coalesce("_n", F.lit(0)), F.coalesce("_f", F.lit(0))
        return (requests.select("entry_id").join(per, "entry_id", "left")
                .select("entry_id", n.alias("attempts"), f.alias("failed"), (n > f).alias("answered")))

    def open_requests(self, requests: DataFrame, max_attempts: int | None = None) -> DataFrame:
        """The rows of ``requests`` without a usable answer (an anti-join); with
        ``max_attempts`` also without those that failed so often."""
        done = self.attempts().groupBy("entry_id").agg(F.max("usable").alias("_ok"), F.count(F.lit(1)).alias("_n"))
        closed = F.col("_ok") if max_attempts is None else F.col("_ok") | (F.col("_n") >= max_attempts)
        return requests.join(done.filter(closed).select("entry_id"), "entry_id", "left_anti")
