"""The event log: appended to by jobs, followed as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from satchel.operators.ranking import latest
from satchel.operators.reports import COMPOSITION, EVENTS_KEPT, activity
from satchel.plans.search import Answer
from satchel.schema import EVENT, QUERY_LOG

# Event types that jobs publish.
EVENT_TYPES = (
    "query_executed", "index_started", "index_completed", "index_failed", "project_created", "project_deleted",
    "points_deleted", "documents_indexed", "migration_started", "migration_progress", "migration_completed",
    "migration_failed",
)


def identified(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of a log: a missing time becomes now, columns that are missing are
    null, and a row without an id gets one made of all it holds."""
    rows = rows.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    for field in schema.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    held = F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"]))
    return rows.withColumn("event_id", F.coalesce(F.col("event_id").cast("long"), F.xxhash64(held))).select(*schema.fieldNames())


def publish(events: DataFrame, path: str) -> None:
    """Append EVENT rows; see ``identified``."""
    identified(events, EVENT).write.mode("append").parquet(path)


def events_from(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """One event per row: its project, and the listed columns as data. Null
    columns stay out of the data."""
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {kind}")
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns]
    known = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else F.array()
    data = F.map_from_entries(known) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(
        F.lit(kind).alias("type"), F.current_timestamp().alias("ts"), F.col("project_id"), data.alias("data")
    )


def told(spark: SparkSession, path: str | None, kind: str, project_id: str, **data: object) -> None:
    """Append one event as it happens; without a log nothing is told."""
    if path is None:
        return
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {kind}")
    held = F.create_map(*[F.lit(x) for k, v in data.items() for x in (k, str(v))]) if data else F.create_map()
    row = spark.range(1).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(kind).alias("type"), F.current_timestamp().alias("ts"), F.lit(project_id).alias("project_id"),
        held.cast("map<string,string>").alias("data"),
    )
    named = row.withColumn("event_id", F.xxhash64("type", "ts", "project_id", F.to_json("data")))
    publish(named, path)


def finished_rounds(spark: SparkSession, path: str | None, run_id: str) -> set[int]:
    """Rounds of a migration that its events tell of; as many as its commits."""
    if path is None:
        return set()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return set()
    data = F.col("data")
    rows = spark.read.schema(EVENT).parquet(path).where((F.col("type") == "migration_progress") & (data["run_id"] == run_id) & data["round"].isNotNull())
    return {r[0] for r in rows.select(data["round"].cast("int")).distinct().collect()}


def query_events(answer: Answer) -> DataFrame:
    """One event for each question that was answered."""
    asked = answer.queries.select("query_id", "project_id", "query")
    return events_from(answer.composition().join(asked, "query_id"), "query_executed", "query", "candidates", "results")


def query_log_rows(answer: Answer, latency_ms: float) -> DataFrame:
    """QUERY_LOG rows of an answered batch, which is named by the batch's
    time. The latency of a question is its share of the batch, since its
    questions were answered by the same jobs; percentiles over a log are
    therefore those of shares. ``query_id`` only goes into the ids."""
    asked = answer.queries.select("query_id", "project_id")
    n = asked.count()
    each = float(latency_ms) / max(1, n)
    rows = answer.composition().join(asked, "query_id").select(
        "query_id", F.current_timestamp().alias("ts"), "project_id", F.lit(each).alias("latency_ms"), *COMPOSITION,
        F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSSSSS").alias("batch_id"), F.lit(float(latency_ms)).alias("batch_ms"), F.lit(n).cast("long").alias("batch_queries"),
    )
    return identified(rows, QUERY_LOG)


def record_queries(log: DataFrame, path: str) -> None:
    """Append QUERY_LOG rows; see ``identified``."""
    identified(log, QUERY_LOG).write.mode("append").parquet(path)


def follow(spark: SparkSession, path: str, schema: T.StructType = EVENT, glob: str | None = None) -> DataFrame:
    """The rows of a Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def of_types(events: DataFrame, types: Sequence[str]) -> DataFrame:
    return events.where(F.col("type").isin(*types))


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Persist a stream exactly once as Parquet, off the producers' path."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def keep_recent(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    n: int,
    group: Sequence[str] = (),
    tie: str = "event_id",
    once: bool = False,
) -> StreamingQuery:
    """Maintain the most recent ``n`` rows, overall or per group.

    Each micro-batch is first cut to its own most recent rows in parallel, so
    a hot group costs at most ``n`` rows per slice, then merged with the rows
    kept so far. Every batch writes its own folder from the one before it, so
    a repeated batch gives the same state.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, n, group, tie=tie).select(*batch.columns)
        if batch_id > 0:
            before = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
            rows = latest(rows.unionByName(before), n, group, tie=tie).select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity_feed(stream: DataFrame, path: str, checkpoint: str, n: int = EVENTS_KEPT, once: bool = False) -> StreamingQuery:
    """The latest events with their descriptions, as ``keep_recent`` state."""
    return keep_recent(stream, path, checkpoint, n, once=once)


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """State after the last finished batch of ``keep_recent``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = []
    for entry in fs.listStatus(folder) if fs.exists(folder) else []:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            done.append(int(entry.getPath().getName().split("=")[1]))
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={max(done)}")


__all__ = [
    "EVENT_TYPES", "activity", "activity_feed", "append_to", "events_from", "follow", "keep_recent", "of_types", "publish",
    "query_log_rows", "read_state", "record_queries",
]
