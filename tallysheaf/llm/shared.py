"""What several operators need: tables kept in the folder all executors share, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

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
        _OWN[app] = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors, read as often as needed."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(table: DataFrame, most: int = 300_000) -> DataFrame:
    """A stored table of short rows, in one partition where it has been counted and has at most ``most`` of them:
    joining and grouping such tables then takes no exchange. Larger ones stay as they are."""
    return table.coalesce(1) if table.count() <= most else table


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge (src, dst of one orderable type).

    Each round every node takes the smallest label among its neighbours' and its own and hands it to the label it had,
    and all labels then jump to the labels of their own, so that long chains shrink by halves. Edges between nodes of
    one label are done with and leave, and the others become edges between labels, each once: tables shrink from round
    to round. Minima combine on the tasks, so a hub with a third of all edges is one row a task. A round writes two tables
    to the shared folder.
    """
    live = stored(edges.select("src", "dst").where("src <> dst").distinct(), name)
    labels = None
    while True:
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hooks = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near")).select("id", F.least("id", "near").alias("component"))
        # Every node points to a smaller one or to itself: pointer jumping ends at the roots.
        roots = stored(hooks, name)
        while True:
            jump = roots.select(F.col("id").alias("component"), F.col("component").alias("jumped"))
            after = stored(roots.join(jump, "component").select("id", F.col("jumped").alias("component"), (F.col("jumped") < F.col("component")).alias("moved")), name)
            roots = after.drop("moved")
            if after.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("id").alias("component"), F.col("component").alias("to"))
            labels = stored(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), name)
        a, b = (roots.select(F.col("id").alias(side), F.col("component").alias(f"{side}_root")) for side in ("src", "dst"))
        live = live.join(a, "src").join(b, "dst").where("src_root <> dst_root")
        live = stored(live.select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).distinct(), name)
        if live.isEmpty():
            return labels
