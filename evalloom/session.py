"""Session helpers: reading the input tables and materialising intermediate results.

Nothing here keeps data on one machine: an intermediate table is written to the shared
folder named by ``spark.checkpoint.dir`` and read back, so that a lost executor costs
only the tasks that ran on it. All intermediates of one application lie in one folder, which is removed when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}
_SCRATCH: list[list[tuple[SparkSession, str, str]]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates.

    ``spark.checkpoint.dir`` of the session where set. Only in plain local mode, as in tests,
    a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='evalloom-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; removed by ``release``, at the latest when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{shared_dir(spark)}/evalloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), _RUNS[app])
    return _RUNS[app]


def remove(jvm, conf, folder: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM is gone already
        pass


def release(spark: SparkSession) -> None:
    """Remove all intermediates of this application. Results that were not read yet are lost, so call it between jobs of a long-lived driver."""
    folder = _RUNS.pop(spark.sparkContext.applicationId, None)
    if folder:
        remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)


@contextmanager
def scratch(*kept: str) -> Iterator[None]:
    """What is materialised within is removed on leaving, but for what was written under the names ``kept``; so results must not read it later."""
    _SCRATCH.append(written := [])
    try:
        yield
    finally:
        _SCRATCH.pop()
        for spark, name, path in written:
            if name not in kept:
                remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
            elif _SCRATCH:
                _SCRATCH[-1].append((spark, name, path))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs started within leave no shuffle files; otherwise these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts its lineage. The shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append((spark, name, path))
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
