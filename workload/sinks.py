"""Queries K01-K08: keyed writes, project life cycle, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.keyed import KEY, delete, delete_project, insert_only, last_wins, upsert
from satchel.operators.points import list_points
from satchel.operators.reports import chunk_counts, counts_of
from satchel.plans.migrate import migrate
from satchel.plans.search import search
from satchel.plans.sync import sync
from satchel.session import scratch_path
from satchel.sources.store import PointStore
from satchel.streaming.events import events_from, publish, query_log_rows, record_queries
from workload.base import FILES_SQL, LOG_SQL, MODEL, POINTS_SQL, SEARCH_SQL, Tables, chunks_sql, query, trial_store, with_

# Conversation turns keyed by (role, conversation): later turns of a role
# replace earlier ones.
TURNS_SQL = """turns AS (SELECT role AS project_id, conv_id::VARCHAR AS id, text AS content, turn AS ordinal FROM conversations),
lasting AS (SELECT project_id, id, arg_max(content, ordinal) AS content FROM turns GROUP BY ALL),
spoken AS (SELECT project_id, id || '#' || ordinal AS id, content FROM turns)"""


def turns(t: Tables) -> DataFrame:
    return t.read("conversations").select(
        F.col("role").alias("project_id"), F.col("conv_id").cast("string").alias("id"), F.col("text").alias("content"),
        F.col("turn").alias("ordinal"),
    )


def spoken(t: Tables) -> DataFrame:
    """All turns, keyed by role and conversation with turn."""
    return turns(t).select("project_id", F.concat_ws("#", "id", F.col("ordinal").cast("string")).alias("id"), "content")


def notes(t: Tables, turn: str = "") -> DataFrame:
    """Documents under the same kind of key, as the user's (first turn of a) conversation."""
    return t.documents.select(
        F.lit("user").alias("project_id"), F.concat(F.col("doc_id").cast("string"), F.lit(turn)).alias("id"), F.col("text").alias("content")
    )


@query(
    "k01_upsert",
    with_(TURNS_SQL)
    + """SELECT project_id, id, content FROM lasting UNION ALL
         SELECT 'user', doc_id::VARCHAR, text FROM documents d
         WHERE NOT EXISTS (SELECT 1 FROM lasting l WHERE l.project_id = 'user' AND l.id = d.doc_id::VARCHAR)""",
)
def upsert_rows(t: Tables) -> DataFrame:
    return upsert(notes(t), last_wins(turns(t)).select("project_id", "id", "content"))


@query(
    "k01_store_upsert",
    with_(POINTS_SQL)
    + """SELECT project_id, id, CASE WHEN source_dir = 'fr' THEN upper(content) ELSE content END AS content, 2 AS version FROM points""",
)
def store_upsert(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    store.upsert(t.points.where("source_dir = 'fr'").withColumn("content", F.upper("content")))
    return store.points().select("project_id", "id", "content", F.lit(store.version()).alias("version"))


@query(
    "k01_reopened_store",
    with_(POINTS_SQL) + "SELECT project_id, id, content || '!' AS content, 16 AS buckets, true AS with_postings FROM points WHERE position > 0",
)
def reopened_store(t: Tables) -> DataFrame:
    """Made with 16 buckets and postings, then opened without saying so."""
    root = scratch_path(t.spark, "store")
    keys = t.indexed.select(*KEY)
    PointStore(t.spark, root, buckets=16, with_postings=True).upsert(t.indexed, keys=keys)
    PointStore(t.spark, root).upsert(t.indexed.withColumn("content", F.concat("content", F.lit("!"))), keys=keys)
    store = PointStore(t.spark, root)
    store.delete_points(t.indexed.where("chunk_index = '0'"))
    return store.points().select(
        "project_id", "id", "content", F.lit(store.buckets).alias("buckets"), F.lit(store.with_postings).alias("with_postings")
    )


@query(
    "k02_insert_only",
    with_(TURNS_SQL)
    + """SELECT project_id, id, content FROM spoken UNION ALL
         SELECT 'user', doc_id || '#0', text FROM documents d
         WHERE NOT EXISTS (SELECT 1 FROM spoken o WHERE o.project_id = 'user' AND o.id = d.doc_id || '#0')""",
)
def insert_rows(t: Tables) -> DataFrame:
    return insert_only(spoken(t), notes(t, "#0"))


@query(
    "k03_delete_points",
    with_(TURNS_SQL)
    + """SELECT project_id, id, content FROM spoken o WHERE NOT (project_id = 'user' AND EXISTS
         (SELECT 1 FROM labels l WHERE l.quality = 1 AND l.doc_id || '#0' = o.id))""",
)
def delete_rows(t: Tables) -> DataFrame:
    gone = t.read("labels").where("quality = 1").select(
        F.lit("user").alias("project_id"), F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("id")
    )
    return delete(spoken(t), gone)


@query(
    "k03_store_delete",
    with_(POINTS_SQL) + "SELECT project_id, id, content_hash FROM points WHERE position > 0",
)
def store_delete(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    store.delete_points(t.points.where("chunk_index = '0'"))
    return store.points().select("project_id", "id", "content_hash")


@query("k04_delete_project", with_(TURNS_SQL) + "SELECT project_id, id, content FROM spoken WHERE project_id <> 'user'")
def drop_project(t: Tables) -> DataFrame:
    return delete_project(spoken(t), "user")


@query(
    "k04_store_delete_project",
    with_(POINTS_SQL) + "SELECT project_id, count(*) AS chunk_count FROM points WHERE project_id <> 'src1' GROUP BY 1",
)
def store_drop_project(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    store.delete_project("src1")
    return chunk_counts(store.points())


@query(
    "k05_create_project",
    with_(POINTS_SQL)
    + "SELECT project_id, count(*) AS chunk_count FROM points GROUP BY 1 UNION ALL SELECT 'empty one', 0",
)
def create_project(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    store.create_project("empty one")
    store.create_project("empty one")
    return counts_of(store.projects(), store.points())


@query("k06_record_queries", with_(LOG_SQL) + "SELECT project_id, latency_ms, results FROM query_log UNION ALL SELECT project_id, latency_ms, results FROM query_log")
def append_metrics(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "query-log")
    record_queries(t.query_log, path)
    record_queries(t.query_log.withColumn("ts", F.lit(None).cast("timestamp")), path)
    return t.spark.read.parquet(path).where("ts IS NOT NULL").select("project_id", "latency_ms", "results")


@query("k07_publish_events", "SELECT event_type AS type, count(*) AS n, count(*) AS with_time FROM events GROUP BY 1")
def publish_events(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "event-log")
    publish(t.event_log.withColumn("ts", F.when(F.col("type") != "click", F.col("ts"))), path)
    return t.spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("n"), F.count("ts").alias("with_time"))


@query(
    "k07_sync_events",
    with_(FILES_SQL, chunks_sql())
    + """SELECT f.project_id, 'index_completed' AS type, count(*)::VARCHAR AS files_scanned,
           (SELECT count(*) FROM chunks c WHERE c.project_id = f.project_id)::VARCHAR AS indexed, '0' AS deleted FROM files f GROUP BY 1""",
)
def sync_events(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "event-log")
    report = sync(trial_store(t), t.files, model=MODEL)
    publish(events_from(report, "index_completed", "indexed", "deleted", "files_scanned", "skipped"), path)
    keys = ("files_scanned", "indexed", "deleted")
    return t.spark.read.parquet(path).select("project_id", "type", *[F.col("data")[k].alias(k) for k in keys])


@query(
    "k07_query_events",
    with_(SEARCH_SQL)
    + """SELECT q.project_id, 'query_executed' AS type, q.query, count(f.id)::VARCHAR AS candidates
         FROM questions q LEFT JOIN fused f ON q.query_id = f.query_id GROUP BY q.query_id, q.project_id, q.query""",
)
def query_events(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "event-log")
    answer = search(t.questions, t.indexed)
    asked = answer.queries.select("query_id", "project_id", "query")
    publish(events_from(answer.composition().join(asked, "query_id"), "query_executed", "query", "candidates"), path)
    return t.spark.read.parquet(path).select("project_id", "type", F.col("data")["query"].alias("query"), F.col("data")["candidates"].alias("candidates"))


@query(
    "k06_record_answer",
    with_(SEARCH_SQL)
    + """SELECT q.project_id, true AS hybrid, count(f.id) AS candidates, least(count(f.id), 5) AS results FROM questions q
         LEFT JOIN fused f ON q.query_id = f.query_id GROUP BY q.query_id, q.project_id""",
)
def record_answer(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "query-log")
    record_queries(query_log_rows(search(t.questions.withColumn("compress", F.lit(False)), t.indexed), 213.0), path)
    logged = t.spark.read.parquet(path).where("latency_ms > 0")
    return logged.select("project_id", "hybrid", F.col("candidates").cast("long").alias("candidates"), F.col("results").cast("long").alias("results"))


@query(
    "k08_migrated_write",
    """SELECT 'copied' AS project_id, doc_id::VARCHAR AS id, text AS content, lang, 'hash-64' AS embed_model FROM documents""",
)
def migrated_write(t: Tables) -> DataFrame:
    store = trial_store(t)
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("meta"),
    )
    migrate(store, "copied", documents=rows, model=MODEL)
    return store.points(["copied"]).select("project_id", "id", "content", F.col("meta")["lang"].alias("lang"), "embed_model")


__all__ = ["list_points"]
