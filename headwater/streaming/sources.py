"""Streams over tables of files, and finite runs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from headwater.session import work_folder


def follow(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files at a path, new ones as they land."""
    schema = spark.read.parquet(path).schema if schema is None else schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may also name a single file.
    path = path.rstrip("/")
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def event_time(stamp: Column) -> Column:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return stamp.cast("timestamp")


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Results and checkpoint live in the shared work folder.
    """
    spark = stream.sparkSession
    out, state = work_folder(spark, label), work_folder(spark, f"{label}-state")
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory, and the only store for processor state."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
