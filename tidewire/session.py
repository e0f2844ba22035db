"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, name: str = "tidewire") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own.

    Driver and executors are one machine here, so where no shared folder is set a
    temporary one will do.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("a session of a cluster is running; use that one, with spark.checkpoint.dir set")
    if not _named(spark) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-"))
    return spark


def _named(spark: SparkSession) -> str | None:
    return spark.conf.get(_FOLDER, None) or spark.sparkContext.getConf().get(_FOLDER)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it."""
    found = _named(spark) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise RuntimeError(f"set {_FOLDER} to a folder that the driver and all executors share")
    return found.rstrip("/")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one, never reused between runs."""
    return f"{shared_dir(spark)}/tidewire-{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, and cut the lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """While this holds, actions send Python at most so many bytes in a batch of rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written tables of one run, below a folder of its own in the shared one.

    A kept table is read back from its files: its lineage ends there, so a lost
    executor costs no earlier step, and the planner knows its size. Tables that no
    later step reads are dropped; what a result still reads stays.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = work_dir(spark, purpose)
        self._kept: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._kept.add(name)
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self._kept.discard(name)

    def drop_but(self, *names: str) -> None:
        """Drop every table but those that the result reads."""
        self.drop(*sorted(self._kept - {*names}))
