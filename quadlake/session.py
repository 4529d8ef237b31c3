"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "quadlake") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUADLAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is missing (tests on one machine) a temporary
    folder is made; on a cluster without the setting this raises, because a
    machine-local folder would be lost with its executor.
    """
    root = _setting(spark, "spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quadlake-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system it lies on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Paths made so far that are not removed yet, and the session of each.
_scratch: dict[str, SparkSession] = {}


def _clean(paths: list[str]) -> None:
    for path in paths:
        spark = _scratch.pop(path)
        try:
            remove_path(spark, path)
        except Exception:  # the session is already gone
            pass


atexit.register(lambda: _clean(list(_scratch)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends, or at the
    end of the scratch_scope it was made in."""
    path = f"{shared_dir(spark)}/quadlake/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Removes at its end what was staged inside it, so that a driver that runs
    for long does not fill the shared folder. Results have to be written or
    collected inside, since they read what is staged."""
    before = set(_scratch)
    try:
        yield
    finally:
        _clean([p for p in _scratch if p not in before])


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and the
    rows survive the loss of any executor."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run: its
    source (a few dozen kB) is sent once per application with addPyFile."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quadlake-src-"), "quadlake-src.zip")
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
