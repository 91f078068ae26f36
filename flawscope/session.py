"""Session construction and the shared scratch location.

All intermediate files (CSV round trips, checkpoints, stored models in tests) go to the
folder named by ``spark.checkpoint.dir``: on a cluster that is a shared, reliable file
system.  Only when the session has none (local tests) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


_SCRATCH: set[str] = set()  # folders handed out by scratch_dir


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "flawscope", extra: dict | None = None) -> SparkSession:
    """Local session for tests/bench.  On a cluster, use the session the platform hands out."""
    parts = shuffle_partitions or (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.debug.maxToStringFields", "2000")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A local master without one gets a new local folder;
    a cluster must name a folder that all its machines share."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="flawscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, tag: str = "scratch") -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def drop_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one scratch folder, or all that this process has asked for (also on a cluster)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in [path] if path else list(_SCRATCH):
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
        _SCRATCH.discard(p)


def materialize(df, mode: str = "checkpoint"):
    """Cut the lineage of a table that several jobs reuse.

    ``checkpoint`` writes it to the shared checkpoint folder: a lost executor costs a re-read,
    not a re-run of every upstream shuffle.  ``table`` writes Parquet to the same shared
    folder and reads it back (columnar: later scans prune columns and push filters).
    ``persist`` keeps it in executor memory / disk (cheaper when the lineage is short).
    """
    from pyspark import StorageLevel

    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "table":
        path = scratch_dir(df.sparkSession, "table")
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK)
