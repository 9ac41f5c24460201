"""Session-level helpers: scratch tables, parallelism, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a
    ``local`` master, where driver and executors are one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in this application's own part of the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = spark
        atexit.register(clear_scratch, spark)
    return f"{scratch_root(spark)}/siltstone/{app}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application; results that still read them must be written or collected before.

    Called when the driver's Python ends; a long-lived application calls it between queries.
    """
    try:
        app = spark.sparkContext.applicationId
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/siltstone/{app}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        return


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it.

    A table survives the loss of executors, is compressed, and its size is
    known to the planner, which a ``checkpoint()`` is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Number of partitions for a stage whose cost is CPU rather than bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy stage at least one partition per core.

    Rows that the planner takes to be as many bytes as that many input splits
    are left where they are, so that large inputs are not shuffled.  Nothing
    is executed to find out.
    """
    spark = df.sparkSession
    n = width(spark)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= n * split else df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root, shared = Path(__file__).parent, scratch_root(spark)
    local = shared.removeprefix("file://").removeprefix("file:")
    # a shared folder on a file system of its own kind can't be written here; Spark then serves the driver's copy
    folder = os.path.join(local, "siltstone", app) if "://" not in local else tempfile.mkdtemp(prefix="siltstone-")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "siltstone.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def task_udf(returns: str):
    """``F.arrow_udf`` for functions of this package, which is sent to the workers first."""
    ship(SparkSession.active())
    return F.arrow_udf(returns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
