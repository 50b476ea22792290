"""Session helpers shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "longspan", cpus: str | None = None, partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@contextmanager
def reused(df: DataFrame):
    """Keep ``df`` while several passes read it; partitions spill to disk and are recomputed if lost."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="longspan-")
        sc.setCheckpointDir(folder)
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared checkpoint folder that nothing has been written to."""
    return f"{_shared_folder(spark)}/longspan/{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths that ``cut_lineage`` wrote inside each open ``temporary_tables`` block, the innermost last.
_blocks: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Delete at the end what ``cut_lineage`` wrote inside, but for tables it was told to keep, which go with the block around.

    What leaves the block must be read from kept tables only. Shuffle files inside go when the write or
    action that made them ends, not when the driver happens to collect its garbage.
    """
    _blocks.append([])
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        for path in _blocks.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back as a plain scan.

    The folder is the one named in ``spark.checkpoint.dir``; a machine-local
    one is used only in local mode where none is set. Being a Parquet table,
    the result survives lost executors and is read with column pruning. With
    ``keep`` it outlives the innermost ``temporary_tables`` block it is written in.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    if owners := _blocks[:-1] if keep else _blocks:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
