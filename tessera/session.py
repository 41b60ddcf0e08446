"""Session helpers: a builder for local runs and checkpoint-directory handling.

Library functions never create sessions; they use the one their input DataFrames
belong to. ``get_session`` is for tests, the bench and command-line jobs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for every job in this package. AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splits hot partitions
# (frequent terms in postings joins, one huge document in sentence joins).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tessera", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """A session. Under ``spark-submit`` (a master is named by the deployment) only the settings
    of ``DEFAULT_CONF`` and ``extra`` are added; else a local one is built."""
    from pyspark import SparkConf

    builder = SparkSession.builder.appName(app)
    conf = dict(DEFAULT_CONF)
    if master or not SparkConf().contains("spark.master"):
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(master or f"local[{cpus}]")
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
        conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
        conf["tessera.scan.partitions"] = cpus
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (pandas UDFs pickle its functions by
    reference). In local mode the workers run on this machine: the package's parent
    directory is put on their ``PYTHONPATH`` (no files written). On a cluster the package
    is shipped by the deployment (``--py-files`` / an installed wheel)."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it only when unset.

    On a cluster the directory must be shared storage named by the deployment in
    ``spark.checkpoint.dir``; we never invent one there. Only a local-mode
    session (tests, the bench) gets a fresh scratch directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises in some versions
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need shared checkpoint storage")
    scratch = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch
