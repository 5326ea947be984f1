"""Streaming eval set equals the batch eval set over the same files."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.functions.text import ustrip
from quarry.operators.querygen import generate_queries
from quarry.streaming import corpus_stream, eval_set_stream, start_eval_set_sink
from tests.test_text import LINES


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    for i in range(2):
        with open(os.path.join(src, f"part{i}.txt"), "w") as f:
            f.write("\n".join(LINES[i::2]) + "\n\n")
    q = start_eval_set_sink(eval_set_stream(spark, src), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    streamed = spark.read.parquet(os.path.join(d, "out"))
    lines = spark.read.text(src).select(F.col("value").alias("text"),
                                        F.col("_metadata.file_path").alias("source_file"))
    lines = lines.select("source_file", ustrip(F.col("text")).alias("text")).filter(F.col("text") != "")
    batch = generate_queries(lines.withColumn(
        "entry_id", F.shiftrightunsigned(F.xxhash64("source_file", "text"), 3)))
    cols = ["entry_id", "row_id", "kind", "query", "context", "relevance"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())
    assert streamed.count() > 0
    assert corpus_stream(spark, src).isStreaming


def test_response_stream_equals_batch(spark):
    from quarry.operators.parse import to_documents
    from quarry.operators.responses import parse_responses
    from quarry.streaming import test_set_stream
    d = tempfile.mkdtemp(prefix="quarry-test-resp-")
    entries = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "entry_id long, text string")
    docs = to_documents(entries)
    resp = spark.createDataFrame(
        [(0, 0, "Can you show me baker magic\n\n  potion  \n"), (1, 0, "soup horror"), (1, 1, None),
         (2, 0, "I want who did it\nGenerate mystery")], "entry_id bigint, resp_id bigint, response string")
    src = os.path.join(d, "in")
    resp.write.parquet(src)
    q = (test_set_stream(spark, src, docs).writeStream.format("parquet")
         .option("path", os.path.join(d, "out")).option("checkpointLocation", os.path.join(d, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    batch = sorted(tuple(r) for r in parse_responses(docs, resp).collect())
    assert streamed == batch and len(batch) == 5
    assert ("baker magic" in [r[3] for r in batch]) and ("mystery" in [r[3] for r in batch])


def test_streamed_answers_are_recorded_once(spark):
    from quarry.operators.ledger import RequestLedger
    from quarry.streaming import responses_stream, start_ledger_sink
    d = tempfile.mkdtemp(prefix="quarry-test-ledger-")
    src, schema = os.path.join(d, "in"), "entry_id bigint, resp_id bigint, response string"
    ledger = RequestLedger(spark, os.path.join(d, "ledger"))
    for rows in ([(0, 1, None), (1, 1, "one")], [(0, 2, "zero"), (1, 2, " ")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        for _ in range(2):
            start_ledger_sink(responses_stream(spark, src), ledger, os.path.join(d, "ck")).awaitTermination(120)
    assert sorted(map(tuple, ledger.answers().collect())) == [(0, 2, "zero"), (1, 1, "one")]
    assert ledger.attempts().count() == 4
    ledger.record(spark.createDataFrame([(0, 1, None), (1, 1, "one")], schema), "stream-0")      # the first batch done again
    assert ledger.attempts().count() == 4 and ledger.open_requests(spark.range(3).withColumnRenamed("id", "entry_id")).count() == 1


def test_equal_lines_of_a_file_get_ids_of_their_own(spark):
    from quarry.streaming import numbered_entries, start_numbered_sink
    d = tempfile.mkdtemp(prefix="quarry-test-numbered-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    os.makedirs(src)
    line = "<Horror> </Horror> <Cats> </Cats> prompt some haunted castle story"
    for name, n in (("a.txt", 3), ("b.txt", 1)):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join([line] * n + [f"prompt other words {name[0]}word"]) + "\n")
    start_numbered_sink(spark, src, out, os.path.join(d, "ck")).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len({r.entry_id for r in rows if r.context == line}) == 4
    assert len({r.row_id for r in rows}) == len(rows)
    # a later file adds rows, a batch done again changes nothing
    with open(os.path.join(src, "c.txt"), "w") as f:
        f.write(line + "\n" + line + "\n")
    start_numbered_sink(spark, src, out, os.path.join(d, "ck")).awaitTermination(120)
    more = spark.read.parquet(out).collect()
    assert len({r.entry_id for r in more if r.context == line}) == 6
    assert {r.row_id for r in rows} < {r.row_id for r in more} and len({r.row_id for r in more}) == len(more)
    files = spark.read.text(src).select(F.col("_metadata.file_path").alias("source_file"), ustrip(F.col("value")).alias("text"))
    once = generate_queries(numbered_entries(files.filter("text <> ''")))
    assert sorted(r.row_id for r in once.collect()) == sorted(r.row_id for r in more)
