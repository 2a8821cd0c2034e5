"""Session construction and the shared checkpoint folder.

On a cluster the session is created by the platform; operators only read
``spark.checkpoint.dir`` from it. A local default is set only when the setting
is absent (tests, local bench runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "costwise",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    AQE stays on so joins against small per-model aggregates are re-planned
    as broadcasts at runtime and skewed shuffle partitions are split.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        # local mode: the driver JVM is the executor; ignored once a JVM is up
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Order: a directory already set on the SparkContext, then
    ``spark.checkpoint.dir`` from the session or the launch configuration.
    Only where none is set and the master is local (tests, local bench runs) a
    fresh scratch folder is created and registered; on a cluster a machine-local
    folder would lose what executors write, so the missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    current = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_CONF} names no shared folder; set it for master {sc.master}")
    local = tempfile.mkdtemp(prefix="costwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set(CHECKPOINT_CONF, local)
    except Exception:  # noqa: BLE001 - a static conf on some deployments; the context setting suffices
        pass
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def materialize(df, name: str):
    """Cut lineage by writing ``df`` once as a Parquet table in the shared
    checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint()`` on an un-persisted plan, the plan runs once;
    the table lives on the cluster's shared storage, so a lost executor costs a
    re-read, not a recomputation, and no machine-local folder is involved."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
