"""Session and lineage helpers. No setting of a caller's session is changed.

The library never creates a cluster session itself when one exists: callers pass
their ``SparkSession``. ``local_session`` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The caller's option for CPU-heavy scans of few, large files (see ``spread``).
SPREAD_CONF = "spark.parley.scan.partitions"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "parley") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PARLEY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # text stages are CPU-heavy per byte: after coalescing, keep at least two tasks a core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(2 * n) if (n := _cores(cores)) else "1")
        .config(SPREAD_CONF, str(2 * n) if n else "0")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _cores(cores: int | str) -> int:
    return os.cpu_count() or 1 if str(cores) == "*" else int(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster the folder is the shared one named by ``spark.checkpoint.dir``.
    Only a local-mode session without that setting (tests) gets a fresh folder
    under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running lineage-cutting jobs")
    local_dir = tempfile.mkdtemp(prefix="parley-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the session's checkpoints, which every executor sees."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a CPU-heavy scan over as many partitions as the caller asks for in ``spark.parley.scan.partitions``.

    Unset or 0 leaves the scan's own splits, which is right for inputs of many
    files or row groups; a few large single-group files want the extra shuffle.
    """
    n = int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(n) if n > 0 else df
