"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the operators rely on. All are plain SQL settings, so they can be applied to a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Of a repeated key in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Stateful streams keep their state in RocksDB: it need not fit in the executor heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Session windows merge within a task before the shuffle, so that a busy key is sent in pre-merged pieces.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(
    cores: str = "8", app: str = "govlens", memory: str = "8g", shared_dir: str | None = None
) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
    )
    if shared_dir is not None:
        builder = builder.config("spark.checkpoint.dir", shared_dir)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder that ``spark.checkpoint.dir`` names.

    Without that setting a temporary folder is used, but only on a local master: on a cluster the executors could
    not see it, so the call fails instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="govlens-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
