"""Tables written once and read again, so that iterative operators do not drag their whole lineage along."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        key = spark.sparkContext.applicationId
        found = _own_folder.get(key)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = _own_folder[key] = tempfile.mkdtemp(prefix="labquarry-")
    return found.rstrip("/")


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/labquarry-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A path in the application's own folder that nothing else uses."""
    return f"{_application_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there, and a lost executor loses nothing.

    by: columns of few values whose folders a filter on them reads alone; they come last in the result.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    names = [c for c in df.columns if c not in (by or [])] + (by or [])
    return spark.read.schema(df.select(*(f"`{c}`" for c in names)).schema).parquet(path)


def drop_stored(*tables: DataFrame | None) -> None:
    """Deletes the files of stored() tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if "/labquarry-" in folder:
                    _delete(df.sparkSession, folder)


def drop_all_stored(spark: SparkSession) -> None:
    """Deletes what this application has stored: call it when no result of an operator is to be read any more."""
    _delete(spark, _application_folder(spark))
