"""Session construction and the shared working folder."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_PARTITIONS = "spark.warywire.local.partitions"
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the benchmark, with a shared folder of its own unless one is given.

    On a cluster use the session you are given.
    """
    conf.setdefault(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="warywire-"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("warywire")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(LOCAL_PARTITIONS, cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir`` of the session.

    Only a session of one process (master local or local[n]) that names none gets a folder of its
    own; for a cluster that is an error, since executors would not share it.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="warywire-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step", clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, and pins the rows: a retried task reads the same file again
    instead of recomputing a plan whose row order may differ. With ``clean`` the shuffle files of the write are
    deleted as soon as it is done, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEAN_KEY, "false")
    if clean:
        spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEAN_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def spread(df: DataFrame, *by: str, least: int = 4_000, most: int = 200_000) -> DataFrame:
    """``df`` in even parts for work that costs far more per row than its bytes tell: one part per core, fewer if a part would
    get less than ``least`` rows, a multiple of the cores if it would get more than ``most``.

    Scans and adaptive shuffles cut by bytes, so a small table of costly rows ends up in a few uneven tasks. Rows are put
    by ``by`` (columns that tell them apart; ``message_id`` if none are named) and sorted by it, so a part computed again holds the
    same rows in the same order. Counts ``df``, which should be a table or a filter on one.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, rows // least), cores * math.ceil(rows / (cores * most)) if rows > cores * most else 1)
    by = by or tuple({"message_id"}.intersection(df.columns))
    return df.repartition(parts, *by).sortWithinPartitions(*by) if by else df.repartition(parts)


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``broadcast(df)`` if it provably holds at most ``max_rows`` rows, else ``df`` itself.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the caller's join
    runs as an ordinary shuffled join, so the answer is the same either way.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
