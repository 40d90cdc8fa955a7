"""Session set-up and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_swept: set[str] = set()


def local_session(cpus: int = 8, partitions: int = 8, app: str = "tideline") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> None:
    """Wall-clock columns are compared as UTC micros, so the session's zone must not shift them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that functions which run there can import it where it is not installed; the archive lies in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    target = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "package") + ".zip")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(target.toString())
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only an unset one (tests, local mode) gets a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tideline-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new place for one table or stream in the application's own part of the shared folder, which is deleted when the driver ends."""
    if _own(spark) not in _swept:
        _swept.add(_own(spark))
        atexit.register(sweep, spark)
    return f"{_own(spark)}/{kind}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession) -> None:
    """Deletes everything that `scratch` gave out in this application; tables read from it are then gone. Long-running drivers call it between jobs."""
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session is gone already: nothing can be deleted through it
        pass


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a compressed table in the shared folder.

    Everything upstream runs once, however many plans read the result, and a lost executor costs no recomputation beyond it.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Number of partitions for exchanges whose tasks compute much for few bytes; adaptive coalescing, which goes by bytes, leaves a given number alone."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
