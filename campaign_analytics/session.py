"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job of this package is written for.  AQE re-plans at runtime: it
# coalesces small shuffle partitions toward the advisory size, and splits a skewed
# partition of a sort-merge join whose inputs are both shuffle stages.  Hot keys that
# AQE cannot split (a join fed by another join) are salted explicitly by
# operators.joins.skew_join; dimension broadcasts are decided there on measured sizes.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when the tables that read them do
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # rows of one Arrow batch: whole texts go to Python workers, and some are long
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "campaign-analytics",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`BASE_CONF`.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the data
    (about 128 MB of shuffle output per partition); AQE coalesces from there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is configured.

    The cluster names its shared folder in ``spark.checkpoint.dir``; that is used as is.
    Where it is unset in a local session, as in tests, checkpoints go to a folder of the
    session's own warehouse; on a cluster that folder may be one machine's own, so there an
    unset checkpoint folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for explicit repartitions: the configured shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
