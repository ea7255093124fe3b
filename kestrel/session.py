"""Session construction and the shared folder for lineage cuts.

On a cluster its operator names a shared folder in ``spark.checkpoint.dir``;
every written intermediate (index tables, checkpoints, ingested batches) goes
below it. Only a local session (tests, bench) picks a folder itself when that
setting is missing; elsewhere a missing setting is an error, as a machine-local
folder is a different disk on every node.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from any
    working directory. A cluster ships the package with ``--py-files``."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_REPO_ROOT, *parts])


def get_spark(master: str | None = None, app: str = "kestrel",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a local session for tests and bench. On a cluster pass
    your own session to the operators; none of these settings is needed there."""
    cpus = os.environ.get("BENCH_CPUS")
    master = master or (f"local[{cpus}]" if cpus else "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_worker_path(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder. Raises outside local mode if the session names none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared folder (``unique`` adds a fresh suffix)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tail = "/".join(p.strip("/") for p in parts if p)
    if unique:
        tail = f"{tail}-{uuid.uuid4().hex[:12]}" if tail else uuid.uuid4().hex[:12]
    return f"{base}/kestrel/{tail}"


def materialized(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: later reads and retries after a
    lost executor see the same rows in the same partitions. Spark's cleaner removes
    the files with the frame (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
