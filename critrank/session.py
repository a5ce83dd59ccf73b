"""Session helpers: building a session for local runs and cutting lineage.

On a cluster the session is created by the caller; nothing here overrides
settings that are already present.  The checkpoint folder is read from the
session (``spark.checkpoint.dir``); a private temporary folder is only used
when the master is local and nothing is configured (tests, benches).
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Open ``temporary_tables`` blocks of each thread.
_SCOPES = threading.local()

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "critrank", extra: dict | None = None) -> SparkSession:
    """The active session, untouched; otherwise a new one.

    ``LOCAL_DEFAULTS`` and ``shuffle_partitions`` only go to a new session with a
    local master; on a cluster, the cluster's own settings hold.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(extra or {})
    if master is not None and is_local(master):
        conf = LOCAL_DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """One machine, one JVM (``local-cluster`` isn't)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it if needed.

    Order: an already-set SparkContext folder, then ``spark.checkpoint.dir``
    from the session conf.  Only a local master may fall back to a fresh
    temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not is_local(sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running critrank jobs on a cluster")
    folder = tempfile.mkdtemp(prefix="critrank-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "table", outlives: bool = False, codec: str | None = None) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Used where a derived table is read more than once.  The rows are written as
    Parquet under the session's checkpoint folder and read back: one computation,
    columnar reads with pruning, and files on shared storage, so losing an
    executor loses nothing.  Within ``temporary_tables`` the table goes at the end
    of the block, or, if it ``outlives`` it, at the end of the block around that.
    ``codec``: the files' compression, if not the session's.
    """
    path = scratch_path(df.sparkSession, name, outlives)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared checkpoint folder; what is written there goes as with ``materialize``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/critrank-{name}-{uuid.uuid4().hex}"
    scopes = getattr(_SCOPES, "open", [])
    if len(scopes) > outlives:
        scopes[-1 - outlives].append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that ``materialize`` writes in this block are deleted at its end.

    Results built on them must be written by then.
    """
    scopes = _SCOPES.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for table in scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(conf).delete(path, True)
