"""Tables written in between: they cut a plan's lineage, survive lost executors and can be read as often as needed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application: only in local mode without spark.checkpoint.dir; removed when Python ends.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where it is unset and the master is this machine.

    Tables in spark.checkpoint.dir stay there when the application ends, as Spark's own checkpoints do: results are lazy,
    so only the caller knows when they have been read. Clearing the folder is up to whoever set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sheaf-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
