"""Spark session defaults for the analytics jobs.

The settings are the ones the operators rely on:

* UTC session zone, so ``date`` arithmetic never shifts with the host zone.
* ANSI mode on: a division by zero raises instead of silently producing NULL;
  operators use ``try_divide`` where the reference tolerates a zero denominator.
* AQE on with partition coalescing and skew-join splitting, so joins whose
  sides are not provably small are re-planned from measured shuffle sizes.
* The UI is disabled (no server is started).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "orderscope", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    ``master`` and ``shuffle_partitions`` are only set when given, so on a
    cluster the launcher's values win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("ORDERSCOPE_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_sql_defaults(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL options on an existing session (e.g. the driver's)."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
              "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # static or locked option: keep the session's value
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; we read it from the session.
    Where it is unset, a single-machine master (``local[...]``) gets a fresh local
    folder; any other master is an error, since each executor would write to a
    folder of its own that the others cannot read.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="orderscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a URI or path, and the path as it names it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
