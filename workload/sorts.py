"""Queries W01-W09 and L01-L09: windows, orders, limits, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators import reports
from satchel.operators.compress import compress
from satchel.operators.dense import dense_topk, nearest
from satchel.operators.fusion import best_fused, fuse
from satchel.operators.lexical import lexical_matches, lexical_topk
from satchel.operators.points import list_points, listing_order
from satchel.operators.ranking import batches_of, best_per_group, latest, page, page_after, with_position
from satchel.operators.rerank import apply_hits
from satchel.plans.search import hydrate
from workload.base import (
    DENSE_SQL, FILES_SQL, LEXICAL_SQL, POINTS_SQL, QUESTIONS_SQL, SEARCH_SQL, VECTORS_SQL, Tables, chunks_sql, compressed_sql,
    cosine_sql, query, with_,
)
from workload.projections import LISTED_SQL, hits, listed

CHUNKS_SQL = with_(FILES_SQL, chunks_sql())


@query("w01_dense_rank", with_(POINTS_SQL, QUESTIONS_SQL, DENSE_SQL) + "SELECT query_id, id, round(score, 6) AS score, rank FROM dense")
def dense_rank(t: Tables) -> DataFrame:
    return dense_topk(t.indexed, t.questions).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("w02_lexical_rank", with_(POINTS_SQL, QUESTIONS_SQL, LEXICAL_SQL) + "SELECT query_id, id, lex_score, rank FROM lexical")
def lexical_rank(t: Tables) -> DataFrame:
    return lexical_topk(lexical_matches(t.questions, t.indexed), t.questions).select("query_id", "id", "lex_score", "rank")


@query(
    "w03_compress",
    with_(
        POINTS_SQL, QUESTIONS_SQL, DENSE_SQL,
        "texts AS (SELECT d.query_id, d.id, d.rank, p.content_hash, p.chunk AS content FROM dense d JOIN points p ON d.project_id = p.project_id AND d.id = p.id)",
        compressed_sql("texts"),
    )
    + "SELECT query_id, id, rank FROM compressed",
)
def compressed(t: Tables) -> DataFrame:
    found = dense_topk(t.indexed, t.questions)
    stored = t.indexed.withColumn("content", F.regexp_replace("content", r"^File: [^\n]*\n\n", ""))
    return compress(hydrate(found, stored, ["content", "content_hash"])).select("query_id", "id", "rank")


@query(
    "w04_rerank_order",
    with_(LISTED_SQL)
    + """SELECT * FROM (SELECT h.query_id, l.id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.hit) AS rank
         FROM hits h JOIN listed l ON h.query_id = l.query_id AND h.idx = l.rank - 1) WHERE rank <= 5""",
)
def rerank_order(t: Tables) -> DataFrame:
    rows = listed(t)
    return apply_hits(rows, hits(rows)).where("reranked").select("query_id", "id", "rank")


@query("w05_original_position", with_(LISTED_SQL) + "SELECT query_id, id, rank - 1 AS idx FROM listed")
def original_position(t: Tables) -> DataFrame:
    return listed(t).select("query_id", "id", (F.col("rank") - 1).alias("idx"))


@query(
    "w06_percent_changes",
    """SELECT project_id, b AS seq, done, n AS total, pct AS percent FROM (
         SELECT *, lag(pct) OVER (PARTITION BY project_id ORDER BY b) AS before FROM (
           SELECT project_id, b, n, least(b * 64, n) AS done, least(b * 64, n) * 100 // n AS pct FROM (
             SELECT project_id, n, unnest(range(0, (n + 63) // 64 + 1)) AS b
             FROM (SELECT user_id::VARCHAR AS project_id, sum((props->>'$.k')::INTEGER)::BIGINT AS n FROM events GROUP BY 1)))) WHERE pct <> coalesce(before, -1)""",
)
def percent_changes(t: Tables) -> DataFrame:
    totals = t.query_log.groupBy("project_id").agg(F.sum("candidates").alias("total"))
    return reports.percent_changes(reports.batch_progress(totals)).withColumn("percent", F.col("percent").cast("long"))


@query("w07_latest_events", "SELECT event_id, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_events(t: Tables) -> DataFrame:
    return latest(t.event_log, reports.EVENTS_KEPT).select("event_id", "type")


@query(
    "w07_latest_events_by_project",
    """SELECT user_id::VARCHAR AS project_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency
       FROM events QUALIFY recency <= 8""",
)
def latest_by_project(t: Tables) -> DataFrame:
    rows = t.event_log.select("event_id", "ts", "project_id")
    return latest(rows, reports.EVENTS_SHOWN, ["project_id"]).select("project_id", "event_id", "recency")


@query(
    "w08_batch_numbers",
    "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 64 AS batch FROM events",
)
def batch_numbers(t: Tables) -> DataFrame:
    return batches_of(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 64).select("event_id", "batch")


@query(
    "w09_rank_and_total",
    """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rank, count(*) OVER (PARTITION BY event_type) AS n
       FROM events""",
)
def rank_and_total(t: Tables) -> DataFrame:
    """Rank of every value within its type, from global positions: no task
    sorts a whole type."""
    order = [F.col("event_type").asc(), F.col("value").asc(), F.col("event_id").asc()]
    placed = with_position(t.events.select("event_type", "event_id", "value"), order)
    sizes = placed.groupBy("event_type").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    return placed.join(sizes, "event_type").select("event_id", (F.col("position") - F.col("first")).alias("rank"), "n")


@query(
    "l01_dense_top_k",
    f"""SELECT id, round(score, 6) AS score FROM (SELECT vec_id::VARCHAR AS id, {cosine_sql('embedding', 'q')} AS score
        FROM embeddings, (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)) ORDER BY score DESC, id LIMIT 5""",
)
def dense_top_k(t: Tables) -> DataFrame:
    probe = t.embeddings.agg(F.min_by("embedding", "vec_id")).first()[0]
    return nearest(t.vectors, list(probe), 5).select("id", F.round("score", 6).alias("score"))


@query(
    "l02_fused_order",
    with_(SEARCH_SQL) + "SELECT query_id, id, round(score, 6) AS score, rank FROM fused",
)
def fused_order(t: Tables) -> DataFrame:
    asked = t.questions
    lexical = lexical_topk(lexical_matches(asked, t.indexed), asked)
    found = best_fused(fuse(dense_topk(t.indexed, asked), lexical), asked)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("l03_truncate_to_k", with_(LISTED_SQL) + "SELECT query_id, id, rank FROM listed WHERE rank <= 5")
def truncate(t: Tables) -> DataFrame:
    rows = listed(t)
    none = hits(rows).where("hit < 0")
    return apply_hits(rows, none).select("query_id", "id", "rank")


LISTING_SQL = """listing AS (SELECT project_id, id, source_file, position::VARCHAR AS chunk_index, position FROM chunks)"""


@query(
    "l04_listing_order",
    with_(FILES_SQL, chunks_sql(), LISTING_SQL)
    + "SELECT id, row_number() OVER (ORDER BY source_file, chunk_index, id) - 1 AS position FROM listing",
)
def listing_text_order(t: Tables) -> DataFrame:
    return with_position(list_points(t.points), listing_order()).select("id", "position")


@query(
    "l04_listing_numeric_order",
    with_(FILES_SQL, chunks_sql(), LISTING_SQL)
    + "SELECT id, row_number() OVER (ORDER BY source_file, position, id) - 1 AS position FROM listing",
)
def listing_numeric_order(t: Tables) -> DataFrame:
    return with_position(list_points(t.points), listing_order(numeric=True)).select("id", "position")


PAGE_SQL = "SELECT project_id, source_file, chunk_index, id FROM listing ORDER BY source_file, chunk_index, id LIMIT {limit} OFFSET {offset}"


@query("l05_page", with_(FILES_SQL, chunks_sql(), LISTING_SQL) + PAGE_SQL.format(limit=20, offset=40))
def one_page(t: Tables) -> DataFrame:
    rows = list_points(t.points).select("project_id", "source_file", "chunk_index", "id")
    return page(rows, listing_order(), 40, 20)


@query("l05_rest_of_listing", with_(FILES_SQL, chunks_sql(), LISTING_SQL) + PAGE_SQL.format(limit=1000000000, offset=40))
def rest_of_listing(t: Tables) -> DataFrame:
    rows = list_points(t.points).select("project_id", "source_file", "chunk_index", "id")
    return page(rows, listing_order(), 40, 0)


@query("l06_nth_row", "SELECT value FROM events ORDER BY value LIMIT 1 OFFSET (SELECT floor(0.95 * (count(*) - 1) + 0.5)::BIGINT FROM events)")
def nth_row(t: Tables) -> DataFrame:
    from satchel.operators.percentile import percentiles

    return percentiles(t.query_log, "latency_ms", [("value", 0.95)]).select("value")


@query("l07_files_by_count", CHUNKS_SQL + "SELECT *, row_number() OVER (ORDER BY chunk_count DESC, project_id, file) - 1 AS position FROM (SELECT project_id, source_file AS file, count(*) AS chunk_count FROM chunks GROUP BY ALL)")
def files_by_count(t: Tables) -> DataFrame:
    counted = reports.file_counts(t.chunks)
    return with_position(counted, [F.col("chunk_count").desc(), F.col("project_id").asc(), F.col("file").asc()])


@query("l08_keyset_scroll", CHUNKS_SQL + "SELECT id FROM chunks WHERE id > 'en/doc_2' ORDER BY id LIMIT 256")
def keyset(t: Tables) -> DataFrame:
    return page_after(t.chunks.select("id"), "id", "en/doc_2")


@query(
    "l09_recall_then_k",
    with_(VECTORS_SQL)
    + f"""SELECT query_id, count(*) AS recalled, count(*) FILTER (WHERE rank <= 5) AS kept FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
              SELECT q.query_id, p.id, {cosine_sql('q.qvec', 'p.embedding')} AS score
              FROM vector_queries q JOIN vectors p ON q.project_id = p.project_id)) WHERE rank <= 40 GROUP BY 1""",
)
def recall_then_k(t: Tables) -> DataFrame:
    found = dense_topk(t.vectors, t.vector_queries)
    return found.groupBy("query_id").agg(F.count("*").alias("recalled"), F.count_if(F.col("rank") <= 5).alias("kept"))
