"""Session and table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("arbolex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ARBOLEX_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a session, for the steps that run in Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="arbolex-")) / f"{package.name}_core.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``; Spark itself opens it, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, *paths: str):
    jvm = spark._jvm
    places = [jvm.org.apache.hadoop.fs.Path(p.rstrip("/")) for p in paths]
    return places[0].getFileSystem(spark._jsc.hadoopConfiguration()), places


def swapped(spark: SparkSession, staged: str, path: str) -> bool:
    """Puts the folder ``staged`` in the place of ``path``. The old one is kept as ``path``.old until the new one is there, and
    ``recovered`` finds it if the caller is lost in between. Says whether the new one is in place."""
    fs, (new, place, old) = _places(spark, staged, path, f"{path.rstrip('/')}.old")
    if not fs.exists(new):
        return False
    if fs.exists(place):
        fs.delete(old, True)
        fs.rename(place, old)
    if not fs.rename(new, place):
        fs.rename(old, place)
        return False
    fs.delete(old, True)
    return True


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, or the old folder beside it where a swap was cut off in between."""
    fs, (place, old) = _places(spark, path, f"{path.rstrip('/')}.old")
    return old.toString() if not fs.exists(place) and fs.exists(old) else path


def work_folder(spark: SparkSession) -> str:
    """A folder that all executors share: below spark.checkpoint.dir; on a local master a temporary one will do."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="arbolex-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return f"{at}/arbolex-{uuid.uuid4().hex}"
