"""Session helpers.

The library never creates its own session inside operators; these helpers
are for tests, the bench and the examples. On a cluster the checkpoint
directory comes from ``spark.checkpoint.dir`` (a shared folder); only when it
is unset (local tests) is a scratch folder chosen here.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "quarry") -> SparkSession:
    master = master or os.environ.get("QUARRY_MASTER", "local[8]")
    cpus = shuffle_partitions or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.default.parallelism", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        conf_dir = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_STAGED: list[tuple[str, str]] = []


def written_rows(df, path: str, *aggs) -> int | tuple:
    """Write ``df`` as Parquet and return its row count, observed by the write itself (no
    second job); with ``aggs`` (named aggregate columns) ``(rows, {name: value})``."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("_rows"), *aggs).write.mode("overwrite").parquet(path)
    values = seen.get
    rows = int(values.pop("_rows") or 0)
    return (rows, values) if aggs else rows


def stage_table(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: a columnar, compressed hand-off that is computed once, cuts lineage
    and survives lost executors. ``drop_staged`` removes the tables."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _STAGED.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df, name: str = "stage", *aggs) -> tuple:
    """:func:`stage_table` with what the write observed: ``(table, rows)``, with ``aggs``
    ``(table, rows, values)``."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    seen = written_rows(df, path, *aggs)
    _STAGED.append((spark.sparkContext.applicationId, path))
    table = spark.read.schema(df.schema).parquet(path)
    return (table, *seen) if aggs else (table, seen)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables staged by this application (call when the results
    built on them are written); returns how many there were."""
    app = spark.sparkContext.applicationId
    mine = [p for a, p in _STAGED if a == app]
    for p in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
        _STAGED.remove((app, p))
    return len(mine)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (pandas UDFs pickle
    references to its modules). On a cluster the package is passed with
    ``--py-files``; in local mode it is zipped once per application and added
    with ``addPyFile``."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if not (sc.master or "").startswith("local"):
        _SHIPPED.add(sc.applicationId)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="quarry-pyfiles-")
    archive = shutil.make_archive(os.path.join(staging, "quarry"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="quarry")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def materialize(df):
    """Eagerly checkpoint ``df`` to the shared checkpoint folder.

    Used where a table is read more than once downstream: it is computed
    once, lineage (and the analysed plan) is cut, and lost executors recompute
    only from the written files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
