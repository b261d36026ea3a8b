"""Session helpers: table access, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 50_000

_cleaned: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need not have it installed."""
    folder = _folder(spark)
    if folder in _shipped:
        return
    _shipped.add(folder)
    packed = io.BytesIO()
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{root.name}.zip")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target.toString())


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, reduced to `columns` when any are named."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of this machine only where Spark runs on it alone."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="matchloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    def drop() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone already
            pass

    atexit.register(drop)


def _folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    folder = f"{shared_dir(spark)}/matchloom-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        _delete_at_exit(spark, folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The application's folder is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted with the application's."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def small(df: DataFrame, rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the row count is within the bound; otherwise leave the join to the shuffle.

    Without a known count (None) the rows are counted, at most limit + 1 of them.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many tasks as there are cores, for work that costs far more than moving its rows.

    A scan that already has that many partitions, as any large one has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
