"""Makes the package importable on the executors, and keeps intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Paths of the tables staged and not deleted yet, in order.
_staged: dict[str, None] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors with the job, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="termloom-")) / "termloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


#: A side is broadcast only when a count has shown it to be at most this many bytes.
BROADCAST_LIMIT = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one made for a session with a local master.

    On a cluster a folder of the driver's own machine would lose rows, so there the setting is asked for.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-termloom-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """This application's own folder of intermediate tables."""
    return f"{shared_dir(spark)}/termloom-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    _staged[path] = None
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*frames: DataFrame) -> None:
    """Delete the staged tables ``frames`` (as stage gave them), of which all readers have run."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path in _staged:
            del _staged[path]
            _delete(df.sparkSession, path)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` gives, staged; all tables staged on the way to it are deleted, also those that it reads."""
    before = set(_staged)
    out = stage(build(), name)
    for path in [p for p in _staged if p not in before and p != out._staged_path]:
        del _staged[path]
        _delete(out.sparkSession, path)
    return out


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables staged by this application; results that still read them can't be used after that."""
    _staged.clear()
    _delete(spark, staging_dir(spark))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where rows * row_bytes is under BROADCAST_LIMIT; else leave Spark its shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df
