"""Queries X01, X02, X05-X08: whole runs against a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import reports
from satchel.operators.embedding import hash_embed
from satchel.operators.keyed import with_known_projects
from satchel.operators.points import list_points, listing_order
from satchel.operators.ranking import page
from satchel.operators.rerank import rerank_calls
from satchel.operators.usage import read_usage, record_usage
from satchel.plans.migrate import migrate
from satchel.plans.sync import index_documents, sync
from satchel.session import scratch_path
from satchel.sources.documents import documents
from satchel.sources.imports import import_documents
from workload.aggregates import RANKED_SQL, TOKEN_COUNT
from workload.base import FILES_SQL, LOG_SQL, MODEL, Tables, chunks_sql, even, query, trial_store, with_
from workload.joins import BOTH_SQL
from workload.sources import scroll

GONE_SQL = """EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir)
  AND NOT EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir AND e.source_file = o.source_file)"""


@query(
    "x01_first_sync",
    with_(FILES_SQL, chunks_sql())
    + """SELECT f.project_id, (SELECT count(*) FROM chunks c WHERE c.project_id = f.project_id) AS indexed, 0 AS skipped, 0 AS deleted,
         count(*) AS files_scanned FROM files f GROUP BY 1""",
)
def first_sync(t: Tables) -> DataFrame:
    return sync(trial_store(t), t.files, model=MODEL)


@query(
    "x01_sync_project",
    BOTH_SQL
    + f"""SELECT project_id, id, content_hash, content, 'hash-64' AS embed_model FROM fresh UNION ALL
          SELECT o.project_id, o.id, o.content_hash, o.content, 'hash-64' FROM chunks o
          WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.project_id = o.project_id AND n.id = o.id) AND NOT ({GONE_SQL})""",
)
def sync_project(t: Tables) -> DataFrame:
    """The table after the corpus changed and was synced a second time."""
    store = trial_store(t)
    sync(store, t.files, model=MODEL)
    sync(store, t.files_of(t.edited_documents), model=MODEL)
    return store.points().select("project_id", "id", "content_hash", "content", "embed_model")


@query("x01_repeated_sync", with_(FILES_SQL, chunks_sql()) + "SELECT 0 AS indexed, count(*) AS skipped, 0 AS deleted FROM chunks")
def repeated_sync(t: Tables) -> DataFrame:
    store = trial_store(t)
    sync(store, t.files, model=MODEL)
    return sync(store, t.files, model=MODEL).agg(*[F.sum(c).alias(c) for c in ("indexed", "skipped", "deleted")])


@query("x01_repeated_paths", with_(FILES_SQL, chunks_sql()) + "SELECT project_id, id, count(*) AS n FROM chunks GROUP BY ALL")
def repeated_paths(t: Tables) -> DataFrame:
    """Every file comes twice, as from two roots of one name; one row per key stays."""
    store = trial_store(t)
    sync(store, t.files.unionByName(t.files), model=MODEL)
    return store.points().groupBy("project_id", "id").agg(F.count("*").alias("n"))


@query(
    "x01_two_texts_of_a_path",
    with_("grown AS (SELECT * FROM (SELECT source AS project_id, lang AS source_dir, 'doc_' || doc_id || '.txt' AS source_file, text || chr(10) || repeat('older text ', 300) AS text FROM documents))", chunks_sql("grown"))
    + "SELECT project_id, id, content_hash FROM chunks",
)
def two_texts(t: Tables) -> DataFrame:
    """Every path comes with two texts; one of them, the larger, is stored whole."""
    store = trial_store(t)
    grown = t.documents.withColumn("text", F.concat("text", F.lit("\n"), F.repeat(F.lit("older text "), 300)))
    sync(store, t.files.unionByName(t.files_of(grown)), model=MODEL)
    return store.points().select("project_id", "id", "content_hash")


@query(
    "x01_events",
    with_(FILES_SQL, chunks_sql())
    + """SELECT project_id, 'index_started' AS type, NULL AS indexed, NULL AS files_scanned FROM files GROUP BY 1 UNION ALL
         SELECT f.project_id, 'index_completed', n::VARCHAR, m::VARCHAR FROM (SELECT project_id, count(*) AS m FROM files GROUP BY 1) f
         JOIN (SELECT project_id, count(*) AS n FROM chunks GROUP BY 1) c ON f.project_id = c.project_id""",
)
def sync_events(t: Tables) -> DataFrame:
    log = scratch_path(t.spark, "events")
    sync(trial_store(t), t.files, model=MODEL, events=log)
    return t.spark.read.parquet(log).select("project_id", "type", F.col("data")["indexed"].alias("indexed"), F.col("data")["files_scanned"].alias("files_scanned"))


@query(
    "a09_usage_of_runs",
    with_(FILES_SQL, chunks_sql()) + f"SELECT sum({TOKEN_COUNT.replace('text', 'content')})::BIGINT AS tokens_embed, (SELECT sum(length(text))::BIGINT FROM conversations) AS tokens_rerank FROM chunks",
)
def usage_of_runs(t: Tables) -> DataFrame:
    """Tokens as the stages themselves have written them down."""
    log, spark = scratch_path(t.spark, "usage"), t.spark
    sync(trial_store(t), t.files, model=MODEL, usage=log)
    turns = t.read("conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.lit("?").alias("query"), F.col("text").alias("content"), (F.col("turn") + 1).cast("int").alias("rank"), F.lit(3).alias("k"))
    spent = rerank_calls(turns, lambda question, texts, k: ([(0, 1.0)], sum(map(len, texts))), counts_tokens=True).agg(F.sum("tokens")).first()[0]
    record_usage(spark, log, "rerank", spent)
    return reports.token_usage(read_usage(spark, log)).select("tokens_embed", "tokens_rerank")


@query(
    "x05_events",
    """WITH n AS (SELECT count(*) AS n FROM documents) SELECT type, percent FROM (
         SELECT 'migration_started' AS type, NULL::BIGINT AS percent UNION ALL SELECT 'migration_completed', NULL UNION ALL
         SELECT DISTINCT 'migration_progress', least(b * 64, n) * 100 // n FROM (SELECT n, unnest(range(0, (n + 63) // 64 + 1)) AS b FROM n))""",
)
def migration_events(t: Tables) -> DataFrame:
    """A run of three rounds that fails in the second and is taken up again."""
    log, store = scratch_path(t.spark, "events"), trial_store(t)
    pages = import_documents(scroll(t), "pages")
    calls = []

    def flaky(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("model not available")
        return hash_embed(rows)

    run = scratch_path(t.spark, "run").rsplit("-", 1)[1]
    try:
        migrate(store, "imported", documents=pages, embed=flaky, model=MODEL, rounds=3, run_id=run, events=log)
    except RuntimeError:
        migrate(store, "imported", documents=pages, embed=flaky, model=MODEL, rounds=3, run_id=run, events=log)
    told = t.spark.read.parquet(log)
    shown = told.where((F.col("type") != "migration_failed") & F.col("data")["round"].isNull())
    return shown.select("type", F.col("data")["percent"].cast("long").alias("percent"))


@query(
    "x01_sync_prune_tail",
    BOTH_SQL + """SELECT project_id, id, content_hash FROM chunks""",
)
def prune_tail(t: Tables) -> DataFrame:
    """Every file grows by one long passage, then shrinks back."""
    store = trial_store(t)
    grown = t.documents.withColumn("text", F.concat("text", F.lit("\n"), F.repeat(F.lit("tail "), 700)))
    sync(store, t.files_of(grown), model=MODEL)
    sync(store, t.files, model=MODEL, prune_tail=True)
    return store.points().select("project_id", "id", "content_hash")


@query("x02_index_documents", "SELECT conv_id || '#' || turn AS id, text AS content, role AS type, 'memory' AS project_id FROM conversations")
def index_conversations(t: Tables) -> DataFrame:
    store = trial_store(t)
    key = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = documents(t.read("conversations"), F.col("text"), key, F.create_map(F.lit("type"), F.col("role")))
    index_documents(store, rows, "memory", model=MODEL)
    return store.points(["memory"]).select("id", "content", F.col("meta")["type"].alias("type"), "project_id")


@query(
    "x05_migrate_project",
    with_(FILES_SQL, chunks_sql()) + "SELECT 'moved' AS project_id, id, content, content_hash, 64 AS embed_dim FROM chunks WHERE project_id = 'src2'",
)
def migrate_project(t: Tables) -> DataFrame:
    source, destination = trial_store(t), trial_store(t)
    sync(source, t.files, model="old-model")
    migrate(destination, "moved", source=source, source_project="src2")
    return destination.points(["moved"]).select("project_id", "id", "content", "content_hash", "embed_dim")


@query(
    "x05_migrate_pages",
    """SELECT 'imported' AS project_id, CASE WHEN lang = 'en' THEN 'orig-' || doc_id ELSE doc_id::VARCHAR END AS id, text AS content, lang FROM documents""",
)
def migrate_pages(t: Tables) -> DataFrame:
    store = trial_store(t)
    migrate(store, "imported", documents=import_documents(scroll(t), "pages"), model=MODEL)
    return store.points().select("project_id", "id", "content", F.col("meta")["lang"].alias("lang"))


@query(
    "x05_migration_progress",
    """SELECT b AS seq, done, n AS total, pct AS percent FROM (SELECT *, lag(pct) OVER (ORDER BY b) AS before FROM (
         SELECT b, n, least(b * 64, n) AS done, least(b * 64, n) * 100 // n AS pct FROM (
           SELECT n, unnest(range(0, (n + 63) // 64 + 1)) AS b FROM (SELECT count(*) AS n FROM documents)))) WHERE pct <> coalesce(before, -1)""",
)
def migration_progress(t: Tables) -> DataFrame:
    run = migrate(trial_store(t), "imported", documents=import_documents(scroll(t), "pages"), model=MODEL)
    return run.progress.select("seq", "done", "total", F.col("percent").cast("long").alias("percent"))


@query(
    "x06_list_page",
    with_(FILES_SQL, chunks_sql())
    + """SELECT id, source_file, content_hash, 'v2' AS chunk_version, '' AS doc_id, substr(content, 1, 200) AS content, position::VARCHAR AS chunk_index
         FROM chunks WHERE project_id = 'src5' AND source_dir = 'en' ORDER BY source_file, chunk_index, id LIMIT 20 OFFSET 20""",
)
def list_page(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    rows = list_points(store.points(["src5"]), {"source_dir": "en"})
    return page(rows, listing_order(), 20, 20).drop("project_id")


@query(
    "x07_stats",
    with_(FILES_SQL, chunks_sql())
    + """SELECT project_id, count(*) AS chunk_count, (SELECT count(DISTINCT project_id) FROM chunks) AS total_projects,
         (SELECT count(*) FROM chunks) AS total_chunks, 'hash-64' AS embed_model FROM chunks GROUP BY 1""",
)
def stats(t: Tables) -> DataFrame:
    store = trial_store(t)
    store.upsert(t.points)
    totals = reports.global_stats(store.points()).select(F.struct("*")).scalar()
    return reports.chunk_counts(store.points()).select("project_id", "chunk_count", totals.alias("_t")).select(
        "project_id", "chunk_count", "_t.*"
    )


@query(
    "x07_metrics_snapshot",
    with_(LOG_SQL)
    + f"""SELECT s.n AS query_count, s.mean AS avg_ms, s.p50_ms, s.p95_ms, e AS tokens_embed, r AS tokens_rerank, e + r AS tokens_total,
            l.candidates AS last_candidates, l.hybrid AS last_hybrid, true AS persistent, 'parquet' AS backend
          FROM ({RANKED_SQL.format(keys='', part='', part_only='', group='', source='(SELECT value AS v FROM events)')}) s,
               (SELECT (SELECT sum({TOKEN_COUNT})::BIGINT FROM documents) AS e, (SELECT sum({TOKEN_COUNT})::BIGINT FROM conversations) AS r) k,
               (SELECT * FROM query_log ORDER BY ts DESC, event_id DESC LIMIT 1) l""",
)
def snapshot(t: Tables) -> DataFrame:
    snap = reports.metrics_snapshot(t.recorded_log, t.usage)
    return snap.withColumn("avg_ms", even(F.col("avg_ms"))).select(
        "query_count", "avg_ms", "p50_ms", "p95_ms", "tokens_embed", "tokens_rerank", "tokens_total",
        F.col("last_query.candidates").alias("last_candidates"), F.col("last_query.hybrid").alias("last_hybrid"),
        "persistent", "backend",
    )


@query(
    "x08_project_life_cycle",
    with_(FILES_SQL, chunks_sql())
    + """SELECT p.project_id, count(c.id) AS chunk_count, true AS found FROM (
           SELECT DISTINCT project_id FROM chunks WHERE project_id <> 'src4' UNION SELECT 'new one') p
         LEFT JOIN chunks c ON p.project_id = c.project_id AND c.position > 0 GROUP BY 1
         UNION ALL SELECT 'src4', 0, false""",
)
def life_cycle(t: Tables) -> DataFrame:
    """Create one project, drop another, delete the first chunk of each file."""
    store = trial_store(t)
    store.upsert(t.points)
    store.create_project("new one")
    store.delete_project("src4")
    store.delete_points(store.points().where("chunk_index = '0'"))
    asked = t.files.select("project_id").distinct()
    asked = asked.unionByName(asked.select(F.lit("new one").alias("project_id")).distinct())
    known, unknown = with_known_projects(asked, store.projects())
    counted = reports.counts_of(known, store.points()).withColumn("found", F.lit(True))
    missing = unknown.select("project_id", F.lit(0).cast("long").alias("chunk_count"), F.lit(False).alias("found"))
    return counted.unionByName(missing)
