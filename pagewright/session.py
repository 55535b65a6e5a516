"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, read with its own schema so that filters and columns are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))  # Spark's own file server hands it out
    _SHIPPED.add(sc.applicationId)


#: Tables written by ``cut`` and not yet removed, and the folder they stand in, by the id of their application.
_WRITTEN: dict[str, set[str]] = {}
_FOLDER: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A folder of this application below the session's ``spark.checkpoint.dir``. A temporary one only where none is set on one machine."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDER:
        given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if given is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="pagewright-")
        _FOLDER[app], _WRITTEN[app] = f"{given.rstrip('/')}/pagewright-{app}", set()
        atexit.register(_sweep, spark, app)
    return _FOLDER[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a plan that reads it: lineage ends there, and a lost executor costs no more than a read.

    Tables are removed by ``drop``, or all together when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[spark.sparkContext.applicationId].add(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.cut_path = path
    return kept


def scratch(spark: SparkSession) -> str:
    """A new folder of its own in the shared folder, removed when the driver ends."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def drop(*tables: DataFrame | None) -> None:
    """Remove tables that ``cut`` has returned and that no later plan reads. Anything else is left alone."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path and path in _WRITTEN.get(df.sparkSession.sparkContext.applicationId, ()):
            _remove(df.sparkSession, path)
            _WRITTEN[df.sparkSession.sparkContext.applicationId].discard(path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep(spark: SparkSession, app: str) -> None:
    """Remove what is left of an application's tables, if its driver can still be asked."""
    try:
        _remove(spark, _FOLDER[app])
    except Exception:  # the session has ended before: the folder's owner cleans up
        return
