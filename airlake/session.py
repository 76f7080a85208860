"""Session helpers.

Library code never creates its own session; it takes the caller's. These
helpers are for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "airlake") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AIRLAKE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` (or the context's checkpoint
    directory) points at shared storage and is used as is. Only when
    neither is set (local tests) a fresh scratch folder is registered on
    the context; the static config itself is never modified.
    """
    sc = spark.sparkContext
    path = None
    try:
        path = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - not readable through the SQL conf
        path = None
    path = path or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="airlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder and return a
    DataFrame that reads it back (for iterative plans). Reliable
    checkpoints survive executor loss, unlike local ones."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder (of any file system that Spark knows) holds data
    files. Errors other than its absence are raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))
