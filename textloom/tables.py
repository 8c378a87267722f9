"""Tables that cut the lineage of a plan: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has written to.
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where all share a machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textloom.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.checkpoint.dir", found)
    return f"{found.rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: its lineage ends here and lost executors cost nothing.

    by: columns whose values each go to a folder of their own, so that a filter on them reads no more. Tables that are
    not dropped before go when the driver ends.
    """
    folder = shared_dir(df.sparkSession)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, df.sparkSession, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM is gone already, or the store: there is nothing left to do it with
        pass


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables that write_table() gave, once all that was made of them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to at least two tasks a core: rows of few bytes and much work, which adaptive execution would merge
    into few tasks by their size. A larger number of shuffle partitions is kept."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
