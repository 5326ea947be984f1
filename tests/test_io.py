"""Sources and sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from quarry.sources.corpus import load_lines
from quarry.sources.evalset_io import read_eval_csv, sample_preview, write_eval_csv


def test_load_lines_strips_and_drops_blanks(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-corpus-")
    p1, p2 = os.path.join(d, "a.txt"), os.path.join(d, "b.txt")
    with open(p1, "w", newline="") as f:
        f.write("  first line \r\n\r\n\t\n second\r\n")
    with open(p2, "w") as f:
        f.write("third\n   \n")
    got = load_lines(spark, [p1, p2]).orderBy("file_pos", "line_no").collect()
    assert [r.text for r in got] == ["first line", "second", "third"]
    assert [r.file_pos for r in got] == [0, 0, 1]


def test_eval_csv_roundtrip_with_awkward_values(spark):
    rows = [('say "hi", ok', "line1\nline2, with comma", 1.0), ("back\\slash", "", 0.0),
            ("plain", "ctx", 0.5)]
    df = spark.createDataFrame(rows, "query string, context string, relevance double")
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-test-csv-"), "eval")
    write_eval_csv(df, path)
    back = sorted(tuple(r) for r in read_eval_csv(spark, path).collect())
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(back, key=key) == sorted(rows, key=key)      # '' and null stay apart


def test_sample_preview_is_seeded(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "row_id")
    a = [r.row_id for r in sample_preview(df, 5, 1).collect()]
    b = [r.row_id for r in sample_preview(df.repartition(5), 5, 1).collect()]
    assert a == b and len(a) == 5
    assert [r.row_id for r in sample_preview(df, 5, 2).collect()] != a
    assert df.filter(F.col("row_id").isin(a)).count() == 5


def test_sinks_write_readable_files(spark):
    from quarry.sources.evalset_io import write_test_set
    from quarry.sources.reports import comparison_json, comparison_report, write_json, write_lines
    base = tempfile.mkdtemp(prefix="quarry-test-sinks-")
    ts = spark.createDataFrame([("q", "c", ("g",))], "query string, context string, metadata struct<g:string>")
    write_test_set(ts, os.path.join(base, "testset"), "run1")
    back = spark.read.parquet(os.path.join(base, "testset"))
    assert back.filter("run_id = 'run1'").first().metadata.g == "g"
    impr = spark.createDataFrame([("similarity", 0, 0.5, 0.6, 0.1, 20.0), ("mrr", 1, 0.0, 0.1, 0.1, 0.0)],
                                 "metric string, metric_pos int, base double, candidate double, "
                                 "absolute double, relative double")
    lines = comparison_report(impr, None, None, "a", "b", "2026-01-01 00:00:00", title="Performance Metrics")
    write_lines(lines, os.path.join(base, "report"))
    text = [r.value for r in spark.read.text(os.path.join(base, "report")).collect()]
    assert text[0] == "# Model Finetuning Comparison Report"
    assert "| similarity | 0.500 | 0.600 | 0.100 | 20.0% |" in text
    write_json(comparison_json(impr, "a", "b", "2026-01-01 00:00:00"), os.path.join(base, "json"))
    import json
    doc = json.loads(spark.read.text(os.path.join(base, "json")).first().value)
    assert doc["metrics"]["similarity"]["finetuned"] == 0.6 and doc["base_model"] == "a"


def test_missing_file_and_empty_corpus(spark):
    import pytest
    from pyspark.errors import AnalysisException
    from quarry.sources.corpus import require_rows
    d = tempfile.mkdtemp(prefix="quarry-test-guard-")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_lines(spark, [os.path.join(d, "does-not-exist.txt")]).collect()
    empty = os.path.join(d, "blank.txt")
    with open(empty, "w") as f:
        f.write("\n  \n\t\n")
    with pytest.raises(ValueError):
        require_rows(load_lines(spark, [empty]))


def test_files_to_eval_csv(spark):
    from quarry.plans.pipelines import build_eval_set
    from quarry.sources.corpus import corpus_entries
    from tests.test_text import LINES
    d = tempfile.mkdtemp(prefix="quarry-test-p1-")
    p1, p2 = os.path.join(d, "f.txt"), os.path.join(d, "nf.txt")
    with open(p1, "w") as f:
        f.write("\n".join(LINES[:6]) + "\n")
    with open(p2, "w") as f:
        f.write("\n\n".join(LINES[6:]) + "\n")
    entries = corpus_entries(spark, [p1, p2])
    got = [r.text for r in entries.orderBy("entry_id").collect()]
    assert got == [t.strip() for t in LINES]
    ev = build_eval_set(entries)
    out = os.path.join(d, "eval")
    write_eval_csv(ev, out)
    back = read_eval_csv(spark, out)
    assert back.count() == ev.count() > 0
    assert {r.relevance for r in back.collect()} <= {0.0, 1.0}


def _folder(files):
    d = tempfile.mkdtemp(prefix="quarry-test-paths-")
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    return d


def test_files_folders_and_globs_keep_their_place_in_the_list(spark):
    d = _folder({"one/a.txt": "a\n", "one/b.txt": "b\n", "two/c d+ü%20.txt": "c\n", "three/e.txt": "e\n", "three/f.log": "f\n", "g.txt": "g\n"})
    paths = [f"{d}/two/", f"{d}/thr*/*.txt", f"file:{d}/one", f"{d}//g.txt", f"file://{d}/three/f.log"]
    got = {(r.text, r.file_pos) for r in load_lines(spark, paths).collect()}
    assert got == {("c", 0), ("e", 1), ("a", 2), ("b", 2), ("g", 3), ("f", 4)}


def test_a_file_named_twice_belongs_to_the_last_entry(spark):
    d = _folder({"x/a.txt": "a\n", "x/b.txt": "b\n"})
    got = sorted((r.text, r.file_pos) for r in load_lines(spark, [f"{d}/x", f"{d}/x/a.txt"]).distinct().collect())
    assert {(t, p) for t, p in got} == {("a", 1), ("b", 0)}


def test_five_thousand_paths_plan_quickly(spark):
    import time
    d = _folder({f"{i % 50}/f{i}.txt": f"line {i}\n" for i in range(5000)})
    paths = [f"{d}/{i % 50}/f{i}.txt" for i in range(5000)]
    t0 = time.perf_counter()
    lines = load_lines(spark, paths)
    lines._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - t0 < 5
    bad = lines.filter(F.concat(F.lit("line "), F.col("file_pos").cast("string")) != F.col("text"))
    assert lines.count() == 5000 and bad.count() == 0
