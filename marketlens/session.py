"""Session helpers.

Library code never creates a session: it takes the caller's. ``local_session``
exists for tests, the bench and the examples. ``checkpoint_root`` reads the
shared folder the cluster names in ``spark.checkpoint.dir``; only a session
built here (tests) gets a private folder, and only when that setting is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the reports rely on at any scale: adaptive execution re-plans
# joins from real shuffle sizes (size-checked broadcast, skew splitting,
# partition coalescing); UTC keeps calendar parts stable.
#
# unionOutputPartitioning=false: the fact joins the items to a union (rows
# of reviewed and unreviewed orders). If a union of hash-partitioned inputs
# keeps their partitioning, no shuffle precedes that join and adaptive
# execution cannot split a hot order; with a planned shuffle it can. The
# price is one shuffle of the narrow order-level rows.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
}


def apply_scale_conf(spark: SparkSession) -> SparkSession:
    """Apply ``SCALE_CONF`` to an existing session (all are runtime SQL confs)."""
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    return spark


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "marketlens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local session for tests and the bench (Spark UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    extra = dict(extra or {})
    # Catalog tables of tests and the bench go to a private folder, not the
    # working directory.
    extra.setdefault("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="marketlens-wh-"))
    for k, v in {**SCALE_CONF, **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        # Test-only fallback: a fresh private folder per session.
        folder = tempfile.mkdtemp(prefix="marketlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Taken from ``spark.checkpoint.dir``; on a cluster this must be a shared
    file system (HDFS, object store), never a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder "
            "(for example hdfs:///tmp/checkpoints) before materialising reports"
        )
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint root for one materialised table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/marketlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
