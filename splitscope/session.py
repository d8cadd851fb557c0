"""SparkSession helpers.

On a cluster the session comes from the platform; these helpers only fill in
settings that are still unset, so a cluster's own values (above all
``spark.checkpoint.dir``, which must name a shared folder) always win.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on; applied only where the session has no value yet.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a hot user's partition in the join of the first-conversion job
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "splitscope", conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench: small shuffle width, UI off."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # PySpark 4 inspects the Python stack on every API call to annotate error
        # messages; plan building is several times faster without it
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder (``spark.checkpoint.dir``).

    Asked for only where a job writes intermediate tables. A session whose executors are
    threads of the driver (``local[...]``: tests, a laptop) gets a scratch folder where it
    names none; on any cluster, a local one included, the folder must be shared by all
    executors, so a missing setting is an error rather than a silent machine-local path.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (e.g. on HDFS or S3)")
        current = tempfile.mkdtemp(prefix="splitscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def ensure_short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts go to Python in Arrow batches of ``rows`` rows where the session names no number itself.

    Spark's 10,000 rows of whole texts are tens of MB, held by every task several times over:
    in the JVM's buffers beside its heap, and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(rows))
