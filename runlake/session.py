"""Session helpers.

Library operators never change session configuration. These helpers are for
tests, the bench and the driver entry, which build their own local session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Partition sizing: on a cluster the shuffle partition count is set by the
# deployment (AQE coalesces small ones). Locally it matches the core count.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "runlake") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Iterative operators cut lineage with ``DataFrame.checkpoint()`` into this
    folder. It must be on shared storage; the library never invents one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    raise RuntimeError("spark.checkpoint.dir is not set: iterative operators need a shared "
                       "checkpoint folder (set spark.checkpoint.dir on the session)")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Tests and the local driver only: use the session's setting when present,
    else a fresh scratch folder (valid because these sessions are local)."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise
        path = tempfile.mkdtemp(prefix="runlake-ckpt-", dir=os.environ.get("RUNLAKE_SCRATCH", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
        return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder for written
    intermediate tables (never a machine-local temp folder)."""
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/runlake-tables/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as
    ``spark-submit --py-files`` would; the driver serves the archive itself."""
    import shutil
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="runlake-package-")
    archive = shutil.make_archive(os.path.join(folder, "runlake-package"), "zip",
                                  os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
