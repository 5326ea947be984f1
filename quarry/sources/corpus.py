"""Text corpus scans (A1-A3): one record per non-blank, stripped line."""

from __future__ import annotations

import re
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import split_lines, ustrip
from quarry.session import stage_counted


MAX_BROADCAST_SPLITS = 100_000


def load_lines(spark: SparkSession, paths: list[str] | str, splits: bool = False) -> DataFrame:
    """Scan text files, folders or globs in list order: ``source_file, file_pos, line_no, text``
    (and ``split_start``, where the line's file split begins, with ``splits``).

    Lines are stripped (Unicode whitespace) and blank ones dropped. The scan is
    split by Spark like any text source; ``line_no`` is the scan position
    (partition, index), stable for fixed split settings, so
    ``(file_pos, line_no)`` is a deterministic record order; it is only used
    to break ties (first-seen order of duplicate lines). A missing path raises Spark's PATH_NOT_FOUND."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no corpus files given")
    with _few_listing_tasks(spark):
        scan = spark.read.format("text").load(paths)
    manifest = path_manifest(spark, paths, scan.inputFiles())
    raw = scan.select(F.col("value"), F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("_line"))
    # one row per file
    files = spark.createDataFrame(manifest, "_path string, file_pos int")
    files = F.broadcast(files) if len(manifest) <= MAX_BROADCAST_SPLITS else files
    lines = (raw.select(F.col("_file").alias("source_file"), F.col("_line").alias("line_no"),
                        *(["split_start"] if splits else []), ustrip(F.col("value")).alias("text"))
                .filter(F.col("text") != F.lit("")))
    return (lines.join(files, F.regexp_replace(F.col("source_file"), _SCHEME, "") == F.col("_path"))
                 .select("source_file", "file_pos", "line_no", *(["split_start"] if splits else []), "text"))


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _few_listing_tasks(spark: SparkSession):
    """Spark lists paths with a task each, up to 10,000: many paths are dealt to four tasks a core."""
    old = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, old)


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
_GLOB = re.compile(r"[*?\[{]")


def path_manifest(spark: SparkSession, paths: list[str], files: list[str]) -> list[tuple[str, int]]:
    """``(path, list position)`` of every scanned file: it belongs to the last entry of ``paths`` that
    is the file, a folder above it or a glob that matches one of these. Spark has listed the
    files; only globs ask the file system again."""
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    here = _bare(fs.getWorkingDirectory().toUri().getPath())
    places: dict[str, int] = {}
    for i, p in enumerate(paths):
        if _GLOB.search(p):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)  # noqa: SLF001
            found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []  # noqa: SLF001
            places.update((_bare(s.getPath().toUri().getPath()), i) for s in found)
        else:
            bare = _bare(p)
            places[bare if bare.startswith("/") else f"{here}/{bare}"] = i
    out = []
    for f in files:
        uri = re.sub(_SCHEME, "", f)
        at, pos = unquote(uri), -1
        while at:
            pos = max(pos, places.get(at, -1))
            at = at.rpartition("/")[0]
        out.append((uri, pos))
    return out


def _bare(path: str) -> str:
    """A path without scheme, host, doubled and trailing slashes."""
    return re.sub("/+", "/", re.sub(_SCHEME, "", path)).rstrip("/").removeprefix("./")


def require_rows(df: DataFrame, what: str = "corpus") -> DataFrame:
    """Stop when a source yields no records (A3)."""
    if df.isEmpty():
        raise ValueError(f"no {what} records loaded")
    return df


def table_lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Lines of a text column of a table: ``rec_id, line_no, line`` (non-blank, stripped)."""
    return (df.select(F.col(key).alias("rec_id"),
                      F.posexplode(split_lines(F.col(text_col))).alias("line_no", "raw"))
              .select("rec_id", F.col("line_no").cast("bigint").alias("line_no"),
                      ustrip(F.col("raw")).alias("line"))
              .filter(F.col("line") != F.lit("")))


def corpus_entries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Entries of a multi-file corpus: ``entry_id, source_file, text``; ids are unique
    and follow the file order, then the line order (the order in which the files
    are concatenated), with gaps.

    Only the list of file splits is sorted and numbered; an id is the number of its
    split and its place in the scan, so no text is moved."""
    from quarry.operators.ids import dense_index
    lines = load_lines(spark, paths, splits=True)
    key = ["file_pos", "source_file", "split_start"]
    splits, n = stage_counted(dense_index(lines.select(*key).distinct(), key, out="_split"), "splits")
    if not n:                   # A3, told by the write of the splits
        raise ValueError("no corpus records loaded")
    # one row per file split: broadcast when the list is known to be small
    splits = F.broadcast(splits) if n <= MAX_BROADCAST_SPLITS else splits
    same = [lines[c].eqNullSafe(splits[c]) for c in key]
    place = F.col("line_no").bitwiseAND(F.lit((1 << 33) - 1))       # a split is read by one task
    return lines.join(splits, same).select(
        F.shiftleft("_split", 33).bitwiseOR(place).alias("entry_id"), lines["source_file"], "text")
