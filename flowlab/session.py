"""SparkSession construction and the shared checkpoint folder.

On a cluster the session comes from the launcher; ``get_spark`` only fills in
settings the launcher has not set (spark-defaults.conf, ``--conf``), so
cluster-wide values win; explicit arguments (tests, bench) are applied as given.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every flowlab job relies on. AQE re-plans joins from runtime sizes
# (derived host sets become broadcasts only when they are measured small) and
# splits skewed shuffle partitions; the session time zone pins the oracle
# comparison.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # delete reliable-checkpoint files (edge summaries) once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "flowlab", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    from pyspark import SparkConf

    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # settings the launcher already has (spark-defaults.conf, --conf) are kept
    preset = SparkConf()
    conf = {k: v for k, v in DEFAULT_CONF.items() if not preset.contains(k)}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only when unset.

    The fallback is for local runs and tests only: a cluster must name a
    shared folder, because a machine-local one does not survive executor loss.
    """
    existing = checkpoint_dir(spark)
    if existing:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(existing)
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                           "(stored flow tables, edge summaries and stream checkpoints live there)")
    local = tempfile.mkdtemp(prefix="flowlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local
