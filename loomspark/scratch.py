"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_local: dict[str, str] = {}
_cleaned: set[str] = set()
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="loomspark-")
    return _local[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when this process ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/loomspark-{app}/{tag}-{uuid.uuid4().hex[:12]}"
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(lambda: [release(spark, p) for p in _made.pop(app, [])])
    paths_made(spark).append(path)
    for held in getattr(_open, "scopes", []):
        held.append(path)
    return path


@contextmanager
def own_paths() -> Iterator[list[str]]:
    """The paths that this thread takes from fresh_path() inside the block, in their order; other threads' are not among them."""
    held: list[str] = []
    _open.scopes = [*getattr(_open, "scopes", []), held]
    try:
        yield held
    finally:
        _open.scopes = [x for x in _open.scopes if x is not held]


def paths_made(spark: SparkSession) -> list[str]:
    """Paths of fresh_path() that still stand, in the order they were made."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def release(spark: SparkSession, path: str) -> None:
    """Delete a path made by fresh_path(); a stopped session leaves it to the folder's owner."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at interpreter exit; the files are only scratch
        return


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of fresh_path() before the process ends."""
    for path in paths:
        release(spark, path)
        if path in paths_made(spark):
            paths_made(spark).remove(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
