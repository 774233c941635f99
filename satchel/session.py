"""Session defaults, the shared scratch folder and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side that may be broadcast; anything above is joined by shuffle.
SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20
# Rows that may stay on the driver as a local relation.
FEW_ROWS = 1_000
FEW_BYTES = 4 << 20
# Files read by a task whose output outweighs its input many times.
SPLIT_BYTES = 16 << 20


def build_session(app: str = "satchel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Cluster deployments pass their own master, memory and shuffle sizes;
    adaptive execution re-sizes shuffle partitions and splits skewed joins.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, read from ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if root:
        if not current.isDefined():
            spark.sparkContext.setCheckpointDir(root)
        return root
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="satchel-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder, or to ``folder`` in it, and
    read it back.

    Used where one result feeds several branches and recomputing it would run
    a costly or non-repeatable stage again.
    """
    spark = df.sparkSession
    path = f"{folder}/{label}" if folder else scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, folder: str) -> None:
    """Remove a folder got from ``scratch_path`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_splits(spark: SparkSession, size: int = SPLIT_BYTES) -> Iterator[None]:
    """Files are read in tasks of ``size`` at most, for work that makes much
    more of its rows than was read. Many small files count by their size, so
    that the large ones among them do not meet in one task."""
    wanted = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size // 64}
    before = {k: spark.conf.get(k) for k in wanted}
    lower = {k: v for k, v in wanted.items() if v < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[k])}
    for k, v in lower.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k in lower:
            spark.conf.set(k, before[k])


def few_rows(df: DataFrame, max_rows: int = FEW_ROWS, max_bytes: int = FEW_BYTES) -> pa.Table | None:
    """The rows themselves if they are few, else None; one job."""
    held = df.limit(max_rows + 1).toArrow()
    return held if held.num_rows <= max_rows and held.nbytes <= max_bytes else None


def local(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """Rows on the driver as a relation whose size Spark knows."""
    return spark.createDataFrame(rows, schema)


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as Spark plans with it: for a written table, its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: text by its bytes, nested values by their JSON."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            total = total + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.col(field.name))), F.lit(0))
    return total


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> bool:
    """True when ``df`` stays within both bounds: two sums, no row moves."""
    seen = df.agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; above it Spark shuffles."""
    return F.broadcast(df) if is_small(df, max_rows) else df
