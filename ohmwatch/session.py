"""Session settings and the shared folder for checkpoints and run outputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = 4, name: str = "ohmwatch", **conf) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the operators rely on; cluster sizing stays with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Deriving constraints from hundreds of aliases takes the optimiser minutes
    # on the wide feature plans and finds nothing: keys are never NULL here.
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    # HotSpot leaves methods beyond this size uncompiled; wide projections then
    # run faster as the many small methods of the non-fused form.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Streams with several state variables and timers need this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # All stores of an executor share this memory; else each may hold 64 MB and more of what it was given.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "256")
    return spark


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job go when it ends, not when the driver happens to collect its garbage: a chain of
    large written tables else keeps the shuffles of all of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is accepted only for a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ohmwatch-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder for one run's tables."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
