"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors share files: under spark.checkpoint.dir, or in a temporary folder
    where a single machine runs all, as in tests. Executors of their own could not reach the latter, so there it is an
    error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="tallyloom-"))
            atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
        at = f"file://{_scratch[0]}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """A number of tasks that keeps all cores at work where what rows cost is not told by their bytes, by which Spark
    else puts small tables into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Lets what a query shuffled be removed when it has ended, and not only when the driver's memory is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])
    return spark
