"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # The JVM does not compile methods over 8000 bytes; beyond that size Spark's smaller
    # per-operator code is about twice as fast as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
}
# On a cluster shuffles start wide enough for terabytes and AQE merges small partitions
# up to the advisory size, so one setting fits small and large inputs.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def build_session(app: str = "postmill", master: str | None = None, **conf) -> SparkSession:
    """A session with the package defaults; ``conf`` entries win over them.

    Without ``master`` the session is taken to run on the cluster that launched it.
    """
    builder = SparkSession.builder.appName(app)
    defaults = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
    if not (master or "").startswith("local"):
        defaults |= CLUSTER_DEFAULTS
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Bring a session started elsewhere to the settings that results and speed rely on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, DEFAULTS[key])
    return spark


_local_roots: dict[str, str] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in the block go when it has run, not when the driver collects its garbage.

    For writes: a frame that is run again would have to make them anew.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


@contextmanager
def scratch_folder(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A scratch folder that is removed when the block that needs it is done."""
    path = scratch_path(spark, purpose)
    try:
        yield path
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder of this machine; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="postmill-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/postmill/{purpose}-{uuid.uuid4().hex}"
