"""Access to the input tables and to the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, TimestampType


_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; needed where it is not installed on them.

    The archive is read on the driver only: Spark's own file server hands it to the executors, also to those that come later.
    """
    context = spark.sparkContext
    if not getattr(context, "_graphloom_shipped", False):
        package = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="graphloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(path))
        context._graphloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A session without that setting is a local one (tests): it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as a path of the file system, or None where it is on another one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(folder).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of an executor, and lets a
    result that is used several times be computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a parquet folder holds, or no rows where nothing was written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes what ``materialise`` wrote in this process; DataFrames that read it can no longer be evaluated."""
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = 10_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows and ``max_bytes`` of values, else ``df`` as it is.

    Both are measured first, so that nothing is broadcast on trust.
    """
    size = F.length(F.to_json(F.struct(*df.columns))) if any(not _fixed(f.dataType) for f in df.schema) else F.lit(8 * len(df.columns))
    got = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).head()
    return F.broadcast(df) if got["n"] <= max_rows and got["b"] <= max_bytes else df


def _fixed(kind: DataType) -> bool:
    return isinstance(kind, (NumericType, BooleanType, DateType, TimestampType))
