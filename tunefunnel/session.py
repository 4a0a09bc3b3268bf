"""Session helpers: a local session for tests/bench, and the shared scratch
folder used for checkpoints and written intermediate tables.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared filesystem); a private temp folder is only created when that
setting is unset *and* the master is local (tests, bench).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tunefunnel") -> SparkSession:
    """Local session with AQE and skew-join handling on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("TUNEFUNNEL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Uses the context's checkpoint dir, else ``spark.checkpoint.dir``; only in
    local mode does it fall back to a fresh private temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="tunefunnel-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_WRITTEN: list[str] = []


def written_copy(df: DataFrame, name: str = "table") -> str:
    """Write ``df`` as Parquet to a fresh path in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return path


def shared_copy(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage like a checkpoint, and later plans prune columns and push filters."""
    return df.sparkSession.read.schema(df.schema).parquet(written_copy(df, name))


@contextmanager
def partial_keys(spark: SparkSession) -> Iterator[None]:
    """What is run inside may join rows where they are dealt by some of the join's
    keys; only for keys whose groups are bounded."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_copy(spark: SparkSession, path: str) -> None:
    """Remove a table that ``written_copy`` wrote."""
    _WRITTEN.remove(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application wrote with ``shared_copy``."""
    while _WRITTEN:
        drop_copy(spark, _WRITTEN[-1])


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable (shared-folder) checkpoint; pins row layout."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (``addPyFile`` of a zip,
    once per SparkContext).  Needed wherever a pandas function defined here
    runs on executors."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc) if sc._jsc is not None else id(sc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="tunefunnel-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
