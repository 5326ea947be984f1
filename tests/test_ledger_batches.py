"""The request ledger (replays, blanks, latest answer) and the batch files (pruned reads)."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from quarry.operators.ledger import RequestLedger
from quarry.operators.responses import failed_requests, usable
from quarry.operators.training import mini_batches
from quarry.sources.batches import read_batches, read_manifest, write_batches

RESPONSES = "entry_id bigint, resp_id bigint, response string"


@pytest.fixture
def ledger(spark, tmp_path):
    return RequestLedger(spark, str(tmp_path / "ledger"))


def _requests(spark, n=6):
    return spark.range(n).select(F.col("id").alias("entry_id"), F.lit("ask").alias("request"))


def test_blank_answers_are_failures(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n\t \n"), (3, "\n x"), (4, "y")], "entry_id bigint, response string")
    assert [r.u for r in df.orderBy("entry_id").select(usable(F.col("response")).alias("u")).collect()] == [False, False, False, True, True]
    assert sorted(r.entry_id for r in failed_requests(_requests(spark), df).collect()) == [0, 1, 2, 5]


def test_latest_usable_answer_wins_and_replays_change_nothing(spark, ledger):
    one = spark.createDataFrame([(0, 1, "old"), (1, 1, None), (2, 1, " \n "), (3, 1, "three")], RESPONSES)
    two = spark.createDataFrame([(0, 2, "new"), (1, 2, "one"), (3, 2, ""), (3, 3, None)], RESPONSES)
    ask = _requests(spark)
    assert ledger.answers().count() == 0 and ledger.open_requests(ask).count() == 6
    state = None
    for batches in ([("a", one), ("b", two)], [("a", one)], [("b", two), ("a", one)]):
        for name, rows in batches:
            ledger.record(rows, name)
        now = (sorted(map(tuple, ledger.answers().collect())), sorted(map(tuple, ledger.status(ask).collect())),
               sorted(r.entry_id for r in ledger.open_requests(ask).collect()))
        assert state in (None, now)
        state = now
    assert state == ([(0, 2, "new"), (1, 2, "one"), (3, 1, "three")],
                     [(0, 2, 0, True), (1, 2, 1, True), (2, 1, 1, False), (3, 3, 2, True), (4, 0, 0, False), (5, 0, 0, False)],
                     [2, 4, 5])
    assert sorted(r.entry_id for r in ledger.open_requests(ask, max_attempts=1).collect()) == [4, 5]


def test_a_corrected_batch_replaces_itself_only(spark, ledger):
    ledger.record(spark.createDataFrame([(0, 1, "x"), (1, 1, "y")], RESPONSES), "a")
    ledger.record(spark.createDataFrame([(2, 1, "z")], RESPONSES), "b")
    ledger.record(spark.createDataFrame([(0, 1, "x2")], RESPONSES), "a")
    assert sorted(map(tuple, ledger.answers().collect())) == [(0, 1, "x2"), (2, 1, "z")]
    ledger.record(spark.createDataFrame([], RESPONSES), "a")
    assert ledger.attempts().count() == 2
    with pytest.raises(ValueError):
        ledger.record(spark.createDataFrame([], RESPONSES), "../x")


def test_equal_attempts_go_by_batch_name(spark, ledger):
    for name in ("b", "a"):
        ledger.record(spark.createDataFrame([(0, 1, f"from {name}")], RESPONSES), name)
    assert ledger.answers().first().response == "from b"


@pytest.fixture(scope="module")
def batch_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batches") / "set")
    keys = spark.range(1000).select(F.col("id").alias("row_id"))
    rows = mini_batches(keys, ["row_id"], batch_size=16, epochs=2, seed=3).withColumn("text", F.concat(F.lit("t"), F.col("row_id")))
    write_batches(rows, path, per_file=7)
    return path, rows


def test_batches_come_back_whole_and_in_order(spark, batch_path):
    path, rows = batch_path
    back = read_batches(spark, path)
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    m = read_manifest(spark, path).collect()
    assert sum(r.rows for r in m) == 2000 and len(m) == 2 * 9
    assert all(r.first_batch == r.batch_range * 7 and r.last_batch <= r.first_batch + 6 for r in m)


def test_one_batch_touches_one_file(spark, batch_path):
    path, _ = batch_path
    assert len({f for f in read_batches(spark, path).inputFiles()}) == 18
    one = read_batches(spark, path, epoch=1, first=30, last=30)
    got = one.withColumn("f", F.input_file_name()).collect()
    assert len(got) == 16 and {r.batch_id for r in got} == {30} and len({r.f for r in got}) == 1
    assert "epoch=1/batch_range=4" in got[0].f
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.explain(mode="formatted")
    filters = next(line for line in buf.getvalue().splitlines() if line.startswith("PartitionFilters"))
    assert "epoch" in filters and "batch_range" in filters


def test_ranges_across_files_and_replacement(spark, batch_path, tmp_path):
    path, rows = batch_path
    got = read_batches(spark, path, epoch=0, first=5, last=15)
    assert got.count() == 11 * 16 and read_batches(spark, path, first=62).count() == 16      # the last, partial batch of each epoch
    again = str(tmp_path / "again")
    write_batches(rows, again, per_file=7)
    write_batches(rows.filter("epoch = 0"), again, per_file=20)
    assert read_batches(spark, again).count() == 1000 and read_manifest(spark, again).count() == 4
