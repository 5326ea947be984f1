"""Template eval set over a stream of corpus files (Structured Streaming).

Parsing and query generation are stateless per line, so the batch operators
apply unchanged to ``readStream``: new corpus files arriving in a folder are
turned into eval rows and appended to a Parquet table with an exactly-once
file sink (progress kept in the checkpoint location). Entry ids are a hash of
(file path, line text), so replays and restarts give the same rows and the
same seeded keyword draws. In a plain stream equal lines of one file share an id;
:func:`start_numbered_sink` numbers them: a file always lies in one micro-batch, so there
the repeats of a line can be counted, and each gets an id of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.functions.text import ustrip
from quarry.operators.querygen import generate_queries


def corpus_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Non-blank stripped lines of text files appearing in ``folder``:
    ``source_file, entry_id, text``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(folder).select(F.col("value"), F.col("_metadata.file_path").alias("source_file"))
    lines = raw.select("source_file", ustrip(F.col("value")).alias("text")).filter(F.col("text") != "")
    # 61-bit non-negative id, so row_id = entry_id * 4 + kind cannot overflow
    return lines.withColumn("entry_id", F.shiftrightunsigned(F.xxhash64("source_file", "text"), 3))


def eval_set_stream(spark: SparkSession, folder: str, cfg: EvalConfig = DEFAULT_CONFIG) -> DataFrame:
    """Streaming eval rows (same columns as the batch ``generate_queries``)."""
    return generate_queries(corpus_stream(spark, folder), cfg)


def start_eval_set_sink(rows: DataFrame, out_path: str, checkpoint_path: str,
                        available_now: bool = True) -> StreamingQuery:
    """Append streaming eval rows to Parquet; ``available_now`` processes what
    is there and stops (incremental batch), otherwise runs continuously."""
    w = (rows.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint_path).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def numbered_entries(lines: DataFrame) -> DataFrame:
    """``source_file, entry_id, text`` of a batch of whole files (``source_file, text``): every
    line has its own id, the n-th of equal lines of a file that of (file, text, n). Repeats are
    counted map-side, so a line that fills a third of a file is one row a task until then."""
    counted = lines.groupBy("source_file", "text").agg(F.count(F.lit(1)).alias("_n"))
    each = counted.select("source_file", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_i"))
    key = F.when(F.col("_i") == 0, F.xxhash64("source_file", "text")).otherwise(F.xxhash64("source_file", "text", "_i"))
    return each.select("source_file", F.shiftrightunsigned(key, 3).alias("entry_id"), "text")


def start_numbered_sink(spark: SparkSession, folder: str, out_path: str, checkpoint_path: str,
                        cfg: EvalConfig = DEFAULT_CONFIG, available_now: bool = True,
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Eval rows of arriving files with an id per line, as Parquet partitioned by micro-batch. A batch
    that is done again replaces its own partition, so rows appear exactly once."""
    def write(lines: DataFrame, batch: int) -> None:
        rows = generate_queries(numbered_entries(lines.select("source_file", "text")), cfg)
        rows.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch}")

    w = (corpus_stream(spark, folder, max_files_per_trigger).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
