"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headwater.functions.clean import nan_free
from headwater.operators.keys import upsert
from headwater.session import materialise


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", optional: bool = False) -> DataFrame:
    """A table with a declared schema; NaN becomes NULL on the way in.

    An optional source that does not exist is an empty table of that schema. CSV
    columns go by the header's names, in any order; one that is missing is NULL, and
    so is text that its type can't read, which `unreadable_csv` returns.
    """
    try:
        df = _csv(spark, path, schema)[0] if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    return nan_free(df)


def _csv(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, Column]:
    """Typed rows with their text beside them, and whether any text failed to become a value."""
    text = spark.read.csv(path, header=True)
    values, failed = [], F.lit(False)
    for field in schema:
        if field.name in text.columns:
            value = F.col(field.name).try_cast(field.dataType)
            failed = failed | (value.isNull() & F.col(field.name).isNotNull())
        else:
            value = F.lit(None).cast(field.dataType)
        values.append(value.alias(field.name))
    return text.select(*values), failed


def unreadable_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows, as text, in which some column of the schema can't be read as its type."""
    return spark.read.csv(path, header=True).filter(_csv(spark, path, schema)[1])


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows. The plan runs once; without rows no row is written."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("horizon",)) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


_POINTER = "version long, folder string"


def replace_table(df: DataFrame, root: str) -> int:
    """Write a full new version, then point to it.

    Readers see the former version until the pointer's own commit, so a failed
    rebuild leaves the table as it was.
    """
    spark = df.sparkSession
    folder = f"{root}/data-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    version = _newest(spark, root)[0] + 1
    spark.createDataFrame([(version, folder)], _POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def read_current(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The current version of a replaced table, empty before the first."""
    folder = _newest(spark, root)[1]
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(folder)


def _newest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    try:
        pointer = spark.read.schema(_POINTER).parquet(f"{root}/pointer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    row = pointer.agg(F.max("version").alias("version"), F.max_by("folder", "version").alias("folder")).first()
    return (row["version"] or 0), row["folder"]


_MANIFEST = "version long, part string, folder string"


def _part(column: str) -> Column:
    """A partition's value as a name that any file system takes."""
    return F.coalesce(F.hex(F.col(column).cast("string")), F.lit("none"))


def _live(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The manifest's newest version, and the folder that holds each partition now."""
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    rows = manifest.groupBy("part").agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version")).collect()
    return max((r["version"] for r in rows), default=0), {r["part"]: r["folder"] for r in rows}


def read_partitions(spark: SparkSession, root: str, schema: StructType, only: Sequence[str] | None = None) -> DataFrame:
    """A table of versioned partitions as its manifest states it; `only` some of them, by name."""
    live = _live(spark, root)[1]
    paths = [folder for part, folder in sorted(live.items()) if only is None or part in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_partitions(new: DataFrame, root: str, keys: Sequence[str], precedence: Sequence[Column], partition: str) -> None:
    """Upsert into a table of versioned partitions, rewriting only those that get rows.

    Partitions that change are written to a new folder; one row for each in the manifest,
    committed as one file, then names it. Until then readers see the former versions, so
    a writer that stops half way loses and adds nothing. The partitions that `new`
    touches, as many as it has days or months, pass through the driver. One writer at a time.
    """
    spark = new.sparkSession
    new = materialise(new, "upsert")
    touched = [r[0] for r in new.select(_part(partition)).distinct().collect()]
    if not touched:
        return
    version, live = _live(spark, root)
    stored = read_partitions(spark, root, new.schema, touched) if set(touched) & set(live) else None
    folder = f"{root}/data-{uuid.uuid4().hex}"
    merged = upsert(stored, new, keys, precedence).withColumn("_part", _part(partition))
    merged.write.partitionBy("_part").parquet(folder)
    rows = [(version + 1, part, f"{folder}/_part={part}") for part in touched]
    _commit(spark.createDataFrame(rows, _MANIFEST), f"{root}/manifest")


def _commit(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Each row as a JSON document of its own line, NULLs kept."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    nan_free(df).select(body.alias("value")).write.mode("overwrite").text(path)
