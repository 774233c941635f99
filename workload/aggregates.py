"""Queries A01-A19: counts, percentiles, shares, context strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import reports
from satchel.operators.chunking import chunk_files
from satchel.operators.percentile import approx_percentiles, percentiles
from satchel.plans.context import assemble
from satchel.plans.sync import index_documents, plan_sync
from satchel.sources.documents import documents
from workload.base import FILES_SQL, LOG_SQL, Tables, chunks_sql, even, query, trial_store, with_
from workload.joins import BOTH_SQL
from workload.projections import LISTED_SQL, listed

CHUNKS_SQL = with_(FILES_SQL, chunks_sql())

RANKED_SQL = """SELECT {keys}max(n) AS n, max(CASE WHEN pos = floor(0.5 * (n - 1) + 0.5) THEN v END) AS p50_ms,
  max(CASE WHEN pos = floor(0.95 * (n - 1) + 0.5) THEN v END) AS p95_ms, round(avg(v) + 1e-9, 6) AS mean
  FROM (SELECT *, row_number() OVER ({part}ORDER BY v) - 1 AS pos, count(*) OVER ({part_only}) AS n FROM {source}){group}"""


@query("a01_count_points", CHUNKS_SQL + "SELECT d.source AS project_id, count(c.id) AS chunk_count FROM (SELECT DISTINCT source FROM documents UNION SELECT 'absent') d LEFT JOIN chunks c ON d.source = c.project_id GROUP BY 1")
def count_points(t: Tables) -> DataFrame:
    known = t.documents.select(F.col("source").alias("project_id"))
    return reports.counts_of(known.unionByName(t.spark.range(1).select(F.lit("absent").alias("project_id"))), t.chunks)


@query("a02_project_ids", "SELECT DISTINCT source AS project_id FROM documents")
def project_ids(t: Tables) -> DataFrame:
    return reports.project_ids(t.files)


@query("a03_chunk_counts", CHUNKS_SQL + "SELECT project_id, count(*) AS chunk_count FROM chunks GROUP BY 1")
def chunk_counts(t: Tables) -> DataFrame:
    return reports.chunk_counts(t.chunks)


@query(
    "a04_global_stats",
    CHUNKS_SQL + "SELECT count(DISTINCT project_id) AS total_projects, count(*) AS total_chunks, 'hash-64' AS embed_model FROM chunks",
)
def global_stats(t: Tables) -> DataFrame:
    return reports.global_stats(t.points)


@query("a05_project_detail", CHUNKS_SQL + "SELECT project_id, count(*) AS chunk_count FROM chunks WHERE project_id = 'src7' GROUP BY 1")
def project_detail(t: Tables) -> DataFrame:
    return reports.chunk_counts(t.chunks.where("project_id = 'src7'"))


@query("a06_query_count_and_mean", "SELECT user_id::VARCHAR AS project_id, count(*) AS query_count, round(avg(value) + 1e-9, 6) AS avg_ms FROM events GROUP BY 1")
def count_and_mean(t: Tables) -> DataFrame:
    return t.query_log.groupBy("project_id").agg(
        F.count("*").alias("query_count"), even(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).alias("avg_ms")
    )


@query("a07_percentiles", RANKED_SQL.format(keys="", part="", part_only="", group="", source="(SELECT value AS v FROM events)"))
def global_percentiles(t: Tables) -> DataFrame:
    return percentiles(t.query_log, "latency_ms", reports.P50_P95).withColumn("mean", even(F.col("mean")))


@query(
    "a07_percentiles_by_project",
    RANKED_SQL.format(
        keys="project_id, ", part="PARTITION BY project_id ", part_only="PARTITION BY project_id", group=" GROUP BY project_id",
        source="(SELECT user_id::VARCHAR AS project_id, value AS v FROM events)",
    ),
)
def project_percentiles(t: Tables) -> DataFrame:
    found = percentiles(t.query_log, "latency_ms", reports.P50_P95, ["project_id"])
    return found.withColumn("mean", even(F.col("mean")))


@query("a07_approx_percentiles", "SELECT user_id::VARCHAR AS project_id, count(*) AS n, true AS p50_near, true AS p95_near FROM events GROUP BY 1")
def approximate(t: Tables) -> DataFrame:
    """Whether each value's rank is off by no more than the promised share of the rows."""
    found = approx_percentiles(t.query_log, "latency_ms", reports.P50_P95, ["project_id"])
    rows = t.query_log.select("project_id", F.col("latency_ms").alias("v")).join(found, "project_id")
    near = []
    for name, p in reports.P50_P95:
        below, upto = F.count_if(F.col("v") < F.col(name)), F.count_if(F.col("v") <= F.col(name))
        slack, rank = F.first("n") / 10_000 + 1, F.lit(p) * F.first("n")
        near.append(((below <= rank + slack) & (upto >= rank - slack)).alias(name.replace("_ms", "_near")))
    return rows.groupBy("project_id").agg(F.first("n").alias("n"), *near)


@query(
    "a08_recent_latency",
    "WITH r AS (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 512) SELECT (SELECT count(*) FROM events) AS query_count, p50_ms, p95_ms, mean AS avg_ms FROM ("
    + RANKED_SQL.format(keys="", part="", part_only="", group="", source="r") + ")",
)
def recent_latency(t: Tables) -> DataFrame:
    return reports.recent_latency_summary(t.recorded_log).withColumn("avg_ms", even(F.col("avg_ms")))


TOKEN_COUNT = "len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))"


@query(
    "a09_token_sums",
    f"""SELECT e AS tokens_embed, r AS tokens_rerank, e + r AS tokens_total FROM (SELECT
        (SELECT sum({TOKEN_COUNT})::BIGINT FROM documents) AS e, (SELECT sum({TOKEN_COUNT})::BIGINT FROM conversations) AS r)""",
)
def token_sums(t: Tables) -> DataFrame:
    return reports.token_usage(t.usage)


@query(
    "a10_composition",
    """SELECT event_type || (user_id // 10) AS query_id, count(*) AS candidates, count(*) FILTER (WHERE value >= 20) AS dense_count,
         count(*) FILTER (WHERE value < 40) AS lexical_count, least(count(*), 5) AS results FROM events GROUP BY 1""",
)
def composition(t: Tables) -> DataFrame:
    from satchel.plans.search import Answer
    from satchel.operators.ranking import best_per_group

    found = t.events.select(
        F.concat("event_type", F.floor(F.col("user_id") / 10).cast("string")).alias("query_id"),
        F.col("event_id").cast("string").alias("id"),
        (F.col("value") >= 20).alias("in_dense"),
        (F.col("value") < 40).alias("in_lexical"),
    )
    kept = best_per_group(found, ["query_id"], [F.col("id").asc()], 5).withColumn("reranked", F.lit(False)).withColumn(
        "rerank_moved", F.lit(0)
    )
    asked = found.select("query_id", F.lit(True).alias("hybrid")).distinct()
    return Answer(asked, found, kept).composition().select("query_id", "candidates", "dense_count", "lexical_count", "results")


@query(
    "a11_last_query",
    with_(LOG_SQL)
    + """SELECT project_id, hybrid, reranked, candidates, results, dense_count, lexical_count, rerank_moved FROM query_log
         QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def last_query(t: Tables) -> DataFrame:
    return reports.last_query(t.recorded_log, ["project_id"])


TOP_FILES_SQL = """counted AS (SELECT project_id, source_file AS file, count(*) AS chunk_count FROM chunks GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY chunk_count DESC, file) AS rank FROM counted QUALIFY rank <= 8)"""


@query("a12_top_files", with_(FILES_SQL, chunks_sql(), TOP_FILES_SQL) + "SELECT project_id, file, chunk_count, rank FROM top")
def top_files(t: Tables) -> DataFrame:
    return reports.top_files(t.chunks).drop("share")


@query("a13_distinct_files", CHUNKS_SQL + "SELECT project_id, count(DISTINCT source_file) AS files FROM chunks GROUP BY 1")
def distinct_files(t: Tables) -> DataFrame:
    return reports.distinct_files(t.chunks)


@query(
    "a14_share_of_largest",
    with_(FILES_SQL, chunks_sql(), TOP_FILES_SQL)
    + "SELECT project_id, file, round(chunk_count / max(chunk_count) OVER (PARTITION BY project_id), 6) AS share FROM top",
)
def share_of_largest(t: Tables) -> DataFrame:
    return reports.top_files(t.chunks).select("project_id", "file", F.round("share", 6).alias("share"))


@query(
    "a15_origin_share",
    with_(LOG_SQL)
    + """SELECT event_id, round(dense_count / (dense_count + lexical_count), 6) AS dense_share, round(lexical_count / (dense_count + lexical_count), 6) AS lexical_share
         FROM query_log WHERE dense_count + lexical_count > 0""",
)
def origin_share(t: Tables) -> DataFrame:
    return reports.origin_share(t.query_log).select(
        "event_id", F.round("dense_share", 6).alias("dense_share"), F.round("lexical_share", 6).alias("lexical_share")
    )


@query(
    "a16_sync_counters",
    BOTH_SQL
    + """, same AS (SELECT n.project_id, EXISTS (SELECT 1 FROM chunks o WHERE o.project_id = n.project_id AND o.id = n.id
             AND o.content_hash = n.content_hash) AS s FROM fresh n),
         gone AS (SELECT o.project_id FROM chunks o WHERE
             EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir)
             AND NOT EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir AND e.source_file = o.source_file))
         SELECT p.project_id, (SELECT count(*) FROM same x WHERE x.project_id = p.project_id AND NOT s) AS indexed,
           (SELECT count(*) FROM same x WHERE x.project_id = p.project_id AND s) AS skipped,
           (SELECT count(*) FROM gone x WHERE x.project_id = p.project_id) AS deleted, count(*) AS files_scanned
         FROM edited p GROUP BY 1""",
)
def sync_counters(t: Tables) -> DataFrame:
    stored = t.chunks.withColumn("doc_id", F.lit(None).cast("string"))
    return plan_sync(t.files_of(t.edited_documents), stored).result()


@query(
    "a17_context_string",
    with_(LISTED_SQL)
    + """SELECT query_id, string_agg(printf('[score %.3f] %s', score, id), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_results
         FROM listed GROUP BY 1""",
)
def context_string(t: Tables) -> DataFrame:
    return assemble(listed(t).withColumn("content", F.col("id")))


@query(
    "a18_migration_percent",
    """SELECT source AS project_id, b AS seq, least(b * 64, n) AS done, n AS total, least(b * 64, n) * 100 // n AS percent FROM (
         SELECT source, n, unnest(range(0, (n + 63) // 64 + 1)) AS b FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))""",
)
def migration_percent(t: Tables) -> DataFrame:
    totals = t.files.groupBy("project_id").agg(F.count("*").alias("total"))
    return reports.batch_progress(totals).withColumn("percent", F.col("percent").cast("long"))


@query("a19_documents_indexed", "SELECT role AS project_id, count(*) AS n FROM conversations GROUP BY 1")
def documents_indexed(t: Tables) -> DataFrame:
    """What indexing the turns of each role reports, a project per role."""
    store, turns = trial_store(t), t.read("conversations")
    key = F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    # As many roles as the table has, three.
    roles = sorted(r[0] for r in turns.select("role").distinct().collect())
    counts = [(role, index_documents(store, documents(turns.where(F.col("role") == role), F.col("text"), key), role)) for role in roles]
    return t.spark.createDataFrame(counts, "project_id string, n long")


__all__ = ["chunk_files"]
