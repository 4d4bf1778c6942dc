"""Session helpers: a tuned local session for tests and benches, and lineage cuts.

Iterative operators (components, SCC, waves, communities) cut lineage with a
reliable ``checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  We only create our own folder when the session has
none *and* runs in local mode (tests, benches); on a cluster an unset
checkpoint folder is a configuration error, never a silent machine-local temp.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "codeweave",
              extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # VARIANT parsing: duplicate keys keep the last value, as Python's json does
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative operators need a shared "
            "(HDFS/object-store) folder to cut lineage on a cluster")
    path = tempfile.mkdtemp(prefix="codeweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Cuts lineage *and* the logical plan (loop state built from loop state would
    otherwise grow the plan tree every round), computes the data once, and
    survives executor loss -- unlike ``localCheckpoint``.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/codeweave-state/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is nothing yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
