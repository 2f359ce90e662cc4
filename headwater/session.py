"""Session helpers: local sessions, runtime settings, and the shared work folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import headwater

# Runtime SQL settings the plans profit from.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows here are small but costly (page parsing, solves, distances): keep a
    # shuffle's tasks apart even where their bytes are few.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    # Task functions travel by value, so executors need no copy of the package.
    cloudpickle.register_pickle_by_value(headwater)
    return spark


def local_session(cpus: int | str = 8, name: str = "headwater") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named in spark.checkpoint.dir.

    Only where the setting is absent, as in local tests, a folder of our own is
    made, one per process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove, at the end, the intermediate results that `materialise` wrote inside.

    What leaves the block must have been written elsewhere, or be materialised outside of it.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="headwater-")


def materialise(df, label: str, **options):
    """Write a DataFrame to the shared folder, with options of the writer, and read it back.

    Cuts the lineage of a result that several later jobs read, in a way that
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df):
    """A side of a join that moves to where its keys meet, as the other side does: neither is broadcast.

    Spark sizes exploded rows as if each had stayed one and files by their compressed
    bytes, and may send the driver many times its limit of a table that grows with the input.
    """
    return df.hint("merge")
