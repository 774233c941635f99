"""Queries T01-T07: the same results reached by streaming over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import reports
from satchel.session import scratch_path
from satchel.streaming import events, metrics, state
from satchel.streaming.sync import continuous_sync
from workload.base import EDITED_SQL, FILES_SQL, LOG_SQL, MODEL, Tables, chunks_sql, even, query, trial_store, with_


def streamed(t: Tables, rows: DataFrame, label: str, files_per_batch: int | None = None, batches: int | None = None) -> DataFrame:
    """Land rows as files and follow them as a stream, ``files_per_batch`` at a
    time or in so many ``batches``."""
    path = scratch_path(t.spark, label)
    rows.write.parquet(path)
    if batches:
        files_per_batch = max(1, -(-len(t.spark.read.schema(rows.schema).parquet(path).inputFiles()) // batches))
    reader = t.spark.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def checkpoint(t: Tables) -> str:
    return scratch_path(t.spark, "ck")


@query(
    "t01_continuous_sync",
    with_(EDITED_SQL, chunks_sql("edited", "fresh")) + "SELECT project_id, id, content_hash FROM fresh",
)
def continuous(t: Tables) -> DataFrame:
    """First all files, then a change stream: removed files are marked, grown
    ones come with their new text."""
    store = trial_store(t)
    place = ["project_id", "source_dir", "rel_path"]
    after = t.files_of(t.edited_documents)
    removed = t.files.join(after.select(*place), place, "left_anti").withColumn("deleted", F.lit(True))
    stages = [t.files.withColumn("deleted", F.lit(False)), after.withColumn("deleted", F.lit(False)).unionByName(removed)]
    for rows in stages:
        source = streamed(t, rows.select(*place, "length", "text", "deleted"), "changes", batches=2)
        continuous_sync(source, store, checkpoint(t), model=MODEL, once=True, keep=1).awaitTermination()
    return store.points().select("project_id", "id", "content_hash")


@query(
    "t01_two_versions_in_batch",
    with_(FILES_SQL, chunks_sql()) + "SELECT project_id, id, content_hash FROM chunks WHERE source_dir <> 'fr'",
)
def two_versions(t: Tables) -> DataFrame:
    """One batch holds an older and a newer text of each file; French files are deleted last."""
    store = trial_store(t)
    new = t.files.withColumn("deleted", F.lit(False)).withColumn("ordinal", F.lit(2))
    old = new.withColumn("text", F.concat("text", F.lit("\nolder"))).withColumn("ordinal", F.lit(1))
    gone = new.where("source_dir = 'fr'").withColumn("deleted", F.lit(True)).withColumn("ordinal", F.lit(3))
    source = streamed(t, old.unionByName(new).unionByName(gone), "changes")
    continuous_sync(source, store, checkpoint(t), model=MODEL, once=True).awaitTermination()
    return store.points().select("project_id", "id", "content_hash")


@query("t02_event_stream", "SELECT event_id, event_type AS type, user_id::VARCHAR AS project_id FROM events WHERE event_type IN ('error', 'purchase')")
def event_stream(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "typed")
    chosen = events.of_types(streamed(t, t.event_log, "event-log"), ["error", "purchase"])
    events.append_to(chosen, out, checkpoint(t), once=True).awaitTermination()
    return t.spark.read.schema(chosen.schema).parquet(out).select("event_id", "type", "project_id")


@query(
    "t03_running_metrics",
    with_(LOG_SQL)
    + """SELECT project_id, count(*) AS query_count, round(avg(latency_ms) + 1e-9, 6) AS avg_ms, arg_max(candidates, ts) AS last_candidates
         FROM query_log GROUP BY 1""",
)
def running(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "running")
    rows = t.recorded_log.repartition(3, "event_id")
    totals = metrics.running_metrics(streamed(t, rows, "query-log", files_per_batch=1))
    metrics.latest_table(totals, out, checkpoint(t), once=True).awaitTermination()
    return events.read_state(t.spark, out, totals.schema).select(
        "project_id", "query_count", even(F.col("avg_ms")).alias("avg_ms"), F.col("last_query.candidates").alias("last_candidates")
    )


@query(
    "t04_recent_latencies",
    "SELECT user_id::VARCHAR AS project_id, event_id, value AS latency_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 64",
)
def recent(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "recent")
    rows = t.recorded_log.select("event_id", "ts", "project_id", "latency_ms").repartition(3, "event_id")
    source = streamed(t, rows, "query-log", files_per_batch=1)
    events.keep_recent(source, out, checkpoint(t), 64, ["project_id"], once=True).awaitTermination()
    return events.read_state(t.spark, out, rows.schema).select("project_id", "event_id", "latency_ms")


@query(
    "t04_recent_512",
    "SELECT event_id, value AS latency_ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 512",
)
def recent_512(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "recent")
    rows = t.recorded_log.select("event_id", "ts", "latency_ms").repartition(3, "event_id")
    source = streamed(t, rows, "query-log", files_per_batch=1)
    events.keep_recent(source, out, checkpoint(t), reports.LATENCY_SAMPLES, once=True).awaitTermination()
    return events.read_state(t.spark, out, rows.schema).select("event_id", "latency_ms")


@query(
    "t05_progress_throttle",
    """SELECT DISTINCT project_id, least(b * 64, n) * 100 // n AS percent FROM (
         SELECT project_id, n, unnest(range(0, (n + 63) // 64 + 1)) AS b
         FROM (SELECT user_id::VARCHAR AS project_id, sum((props->>'$.k')::INTEGER)::BIGINT AS n FROM events GROUP BY 1))""",
)
def throttle(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "throttled")
    totals = t.query_log.groupBy("project_id").agg(F.sum("candidates").alias("total"))
    progress = reports.batch_progress(totals)
    emitted = metrics.percent_throttle(streamed(t, progress, "progress"))
    events.append_to(emitted, out, checkpoint(t), once=True).awaitTermination()
    return t.spark.read.schema(emitted.schema).parquet(out).select("project_id", F.col("percent").cast("long").alias("percent"))


@query(
    "t03_changed_groups",
    with_(LOG_SQL)
    + """SELECT project_id, count(*) AS query_count, round(avg(latency_ms) + 1e-9, 6) AS avg_ms, arg_max(candidates, ts) AS last_candidates
         FROM query_log GROUP BY 1""",
)
def changed(t: Tables) -> DataFrame:
    """Each batch writes the projects it has changed."""
    out = scratch_path(t.spark, "changes")
    totals = metrics.running_metrics(streamed(t, t.recorded_log.repartition(3, "event_id"), "query-log", files_per_batch=1))
    state.changed_groups(totals, out, checkpoint(t), ["project_id"], once=True).awaitTermination()
    return state.read_changes(t.spark, out, totals.schema, ["project_id"]).select(
        "project_id", "query_count", even(F.col("avg_ms")).alias("avg_ms"), F.col("last_query.candidates").alias("last_candidates")
    )


@query(
    "t04_keyed_state",
    "SELECT user_id::VARCHAR AS project_id, event_id, value AS latency_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 512",
)
def keyed_state(t: Tables) -> DataFrame:
    """List state of the last 512 latencies of each project, read from the checkpoint after a restart."""
    ck = checkpoint(t)
    rows = t.recorded_log.select("event_id", "ts", "project_id", "latency_ms")
    path = scratch_path(t.spark, "query-log")
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        rows.where(part).write.mode("append").parquet(path)
        state.keep_recent_keyed(events.follow(t.spark, path, rows.schema), ck, 512, ["project_id"], once=True).awaitTermination()
    return state.recent_rows(t.spark, ck, 512, ["project_id"]).select("project_id", "event_id", "latency_ms")


@query(
    "t05_progress_runs",
    """SELECT project_id, migration_id, b AS seq, done, n AS total, pct AS percent FROM (
         SELECT *, lag(pct) OVER (PARTITION BY project_id, migration_id ORDER BY b) AS before FROM (
           SELECT project_id, migration_id, n, b, least(b * 64, n) AS done, CASE WHEN n > 0 THEN least(b * 64, n) * 100 // n ELSE 0 END AS pct FROM (
             SELECT user_id::VARCHAR AS project_id, 'm' || (event_id % 2) AS migration_id, sum((props->>'$.k')::INTEGER)::BIGINT AS n FROM events GROUP BY ALL),
             LATERAL (SELECT unnest(range(0, (n + 63) // 64 + 1)) AS b))) WHERE pct IS DISTINCT FROM before""",
)
def progress_runs(t: Tables) -> DataFrame:
    """Two runs of each project; even steps arrive after odd ones."""
    run = ["project_id", F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("migration_id")]
    totals = t.query_log.groupBy(*run).agg(F.sum("candidates").alias("total"))
    steps = reports.batch_progress(totals)
    path, out, ck = scratch_path(t.spark, "progress"), scratch_path(t.spark, "percents"), checkpoint(t)
    for part in ("seq % 2 = 1", "seq % 2 = 0"):
        steps.where(part).write.mode("append").parquet(path)
        state.follow_percents(events.follow(t.spark, path, steps.schema), out, ck, once=True).awaitTermination()
    return t.spark.read.parquet(out).select("project_id", "migration_id", "seq", "done", "total", "percent")


@query(
    "t06_activity_feed",
    """SELECT event_id, event_type AS type, (props->>'$.k') || ' candidates' AS description FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def feed(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "feed")
    rows = t.recorded_events.repartition(3, "event_id")
    source = streamed(t, rows, "event-log", files_per_batch=1)
    events.activity_feed(source, out, checkpoint(t), once=True).awaitTermination()
    kept = events.read_state(t.spark, out, rows.schema)
    return reports.activity(kept).select("event_id", "type", "description")


@query("t07_metric_persistence", with_(LOG_SQL) + "SELECT event_id, latency_ms, hybrid, results FROM query_log")
def persistence(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "durable")
    source = streamed(t, t.query_log, "query-log")
    events.append_to(source, out, checkpoint(t), once=True).awaitTermination()
    return t.spark.read.schema(source.schema).parquet(out).select("event_id", "latency_ms", "hybrid", "results")


__all__ = ["FILES_SQL"]
