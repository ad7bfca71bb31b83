"""Session construction and table access.

The library never creates a session inside an operator.  ``build_session`` is
for scripts, tests and the bench; on a cluster the caller owns the session and
its ``spark.checkpoint.dir`` (a shared folder) is read from there.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime broadcast of join sides measured under this size (aggregate sides are sized here)
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet splits of 128 MiB keep scan tasks well inside executor memory.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "clinlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a ``local`` session without one (a
    test) gets a scratch folder; on a cluster a machine-local folder would be
    lost to the other machines, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="clinlake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
          spread_small: bool = True) -> DataFrame:
    """Read one driver table; selecting ``columns`` here keeps ReadSchema narrow.

    A scan with fewer splits than task slots (a few files of one row group)
    is hash-spread over the slots so downstream per-row work runs in
    parallel; a large table is returned as scanned (no extra shuffle)."""
    from clinlake.plans.parallel import spread

    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    df = df.select(*columns) if columns else df
    return spread(df) if spread_small else df


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]
