"""Shared storage: the folder that driver and executors both see, and tables or files written there.

The folder is ``spark.checkpoint.dir``. Only where that is unset and all executors are in this process (tests, a laptop), a folder of our own is
used; a cluster without that setting is an error. What is written stays there; whoever set the folder may empty it when no result is read any more.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that all executors share; no trailing slash."""
    found = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="quireline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set(_CHECKPOINT, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """URI of a fresh folder under the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    folder = new_folder(spark, tag)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows that travel to Python at once, where the session has not chosen a number: texts may be long, and both sides hold a batch.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows per Arrow batch, unless something else than Spark's default is set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def filesystem(uri: str):
    """(filesystem, path) for a URI; any store that pyarrow knows, and plain paths."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(files, temp: str, final: str) -> None:
    """Give a finished file its name. A second attempt of the same task writes the same bytes, so either may win."""
    files.move(temp, final)
