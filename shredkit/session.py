"""Session construction (C7, C8) and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "shredkit",
    shuffle_partitions: int | None = None,
    catalog: dict[str, str] | None = None,
    extra: dict[str, str] | None = None,
    broadcast_bytes: int = 10 * 1024 * 1024,
    initial_partitions: int | None = None,
    advisory_partition_bytes: int | None = None,
    max_partition_bytes: int | None = None,
) -> SparkSession:
    """A session with the settings results depend on.

    * ``spark.sql.session.timeZone=UTC``: timestamp text (and so content hashes)
      must not depend on the machine's zone.
    * AQE on, with skew-join splitting and partition coalescing.
    * Aggregates shuffle on all their grouping keys instead of reusing a
      partitioning on some of them (a dedup on every column must not stay
      partitioned by a document id that may hold a third of the rows).
    * Broadcasts only on *measured* sizes: the planner's static estimate is off
      (it can be far too low after an aggregate that builds arrays), and AQE
      turns a shuffle join into a broadcast join only when the materialised
      side is under ``broadcast_bytes``.
    * Sizing: ``initial_partitions`` is the shuffle width AQE starts from and
      coalesces down from (set it high on a large cluster, e.g. input bytes /
      256 MB); ``advisory_partition_bytes`` is the size AQE aims at for shuffle
      partitions and rebalanced write files; ``max_partition_bytes`` sizes
      input splits.
    * ``catalog``: plain ``spark.sql.catalog.<name>.*`` options for a V2 table
      catalog (Iceberg with a Glue or warehouse catalog, for instance); passed
      through as given.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.requireAllClusterKeysForDistribution": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if initial_partitions:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions)
    if advisory_partition_bytes:
        conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(advisory_partition_bytes)
    if max_partition_bytes:
        conf["spark.sql.files.maxPartitionBytes"] = str(max_partition_bytes)
    for k, v in (catalog or {}).items():
        conf[k if k.startswith("spark.") else f"spark.sql.catalog.{k}"] = v
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and every executor can reach it.
    Only on a local master, where it may be unset (tests), do we create one: a
    folder of one machine would lose what other executors write.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect has no SparkContext
            d = None
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shredkit-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            pass
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Cores the session can use at once (falls back to shuffle partitions)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect has no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the scratch root."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def table_catalog_conf(name: str, kind: str, warehouse: str,
                       extra: dict[str, str] | None = None) -> dict[str, str]:
    """Spark conf for an Iceberg catalog called ``name``.

    ``kind="glue"`` uses the Glue catalog implementation with S3 file IO;
    anything else is a path-based (``hadoop``) catalog under ``warehouse``.
    Only one of ``type`` / ``catalog-impl`` is set, as the catalog requires.
    The jars must be on the cluster's classpath.
    """
    p = f"spark.sql.catalog.{name}"
    conf = {
        p: "org.apache.iceberg.spark.SparkCatalog",
        f"{p}.warehouse": warehouse,
        "spark.sql.extensions":
            "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions",
    }
    if kind.lower() == "glue":
        conf[f"{p}.catalog-impl"] = "org.apache.iceberg.aws.glue.GlueCatalog"
        conf[f"{p}.io-impl"] = "org.apache.iceberg.aws.s3.S3FileIO"
    else:
        conf[f"{p}.type"] = "hadoop"
    conf.update(extra or {})
    return conf


def safe_planning(spark: SparkSession) -> dict[str, str]:
    """Settings the table operators run under, whatever session they are given:
    no broadcast from static estimates (AQE keeps the session's limit for
    measured sizes) and aggregates shuffled on all their keys."""
    static = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    return {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": adaptive or static,
        "spark.sql.requireAllClusterKeysForDistribution": "true",
    }


@contextmanager
def scoped_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Set SQL conf for the duration of a block, then restore what was there."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
