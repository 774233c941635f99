"""Queries J01-J12 and U01-U04: joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.chunking import chunk_files
from satchel.operators.dense import dense_topk
from satchel.operators.embedding import by_returned_index
from satchel.operators.fusion import full_outer
from satchel.operators.keyed import delete, upsert, with_known_projects
from satchel.operators.lexical import build_postings, lexical_matches, lexical_topk
from satchel.operators.rerank import apply_hits
from satchel.plans.sync import mark_unchanged, stale_points
from satchel.sources.imports import id_and_vector_pages
from workload.base import (
    DENSE_SQL, EDITED_SQL, FILES_SQL, LEXICAL_SQL, MATCHES_SQL, POINTS_SQL, QUESTIONS_SQL, VECTORS_SQL, Tables, chunks_sql,
    cosine_sql, query, with_,
)
from workload.projections import LISTED_SQL, hits, listed
from workload.sinks import TURNS_SQL, notes, spoken

BOTH_SQL = with_(FILES_SQL, chunks_sql(), EDITED_SQL, chunks_sql("edited", "fresh"))


@query(
    "j01_incremental_skip",
    BOTH_SQL
    + """SELECT n.project_id, n.id, n.content_hash, EXISTS (
           SELECT 1 FROM chunks o WHERE o.project_id = n.project_id AND o.id = n.id AND o.content_hash = n.content_hash) AS unchanged
         FROM fresh n""",
)
def incremental_skip(t: Tables) -> DataFrame:
    fresh = chunk_files(t.files_of(t.edited_documents))
    stored = t.chunks.withColumn("doc_id", F.lit(None).cast("string"))
    return mark_unchanged(fresh, stored).select("project_id", "id", "content_hash", "unchanged")


@query(
    "j02_stale_points",
    BOTH_SQL
    + """SELECT o.project_id, o.id FROM chunks o WHERE
           EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir)
           AND NOT EXISTS (SELECT 1 FROM edited e WHERE e.project_id = o.project_id AND e.source_dir = o.source_dir
                           AND e.source_file = o.source_file)""",
)
def stale(t: Tables) -> DataFrame:
    return stale_points(t.chunks, t.files_of(t.edited_documents))


@query(
    "j03_hybrid_full_outer",
    with_(POINTS_SQL, QUESTIONS_SQL, DENSE_SQL, LEXICAL_SQL)
    + """SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.id, l.id) AS id, d.id IS NOT NULL AS in_dense,
           l.id IS NOT NULL AS in_lexical, d.rank AS dense_rank, l.rank AS lexical_rank
         FROM dense d FULL OUTER JOIN lexical l ON d.query_id = l.query_id AND d.id = l.id""",
)
def hybrid_full_outer(t: Tables) -> DataFrame:
    dense = dense_topk(t.indexed, t.questions)
    lexical = lexical_topk(lexical_matches(t.questions, t.indexed), t.questions)
    return full_outer(dense, lexical).drop("project_id")


@query(
    "j04_rerank_hits",
    with_(LISTED_SQL)
    + """SELECT query_id, id, score, rank, reranked FROM (
           SELECT h.query_id, l.id, h.relevance_score AS score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.hit) AS rank, true AS reranked
           FROM hits h JOIN listed l ON h.query_id = l.query_id AND h.idx = l.rank - 1) WHERE rank <= 5
         UNION ALL SELECT query_id, id, score, rank, false FROM listed WHERE query_id LIKE '%:0' AND rank <= 5""",
)
def rerank_hits(t: Tables) -> DataFrame:
    rows = listed(t)
    return apply_hits(rows, hits(rows)).select("query_id", "id", "score", "rank", "reranked")


@query(
    "j05_rerank_moved",
    with_(LISTED_SQL)
    + """SELECT query_id, count(*) FILTER (WHERE rank - 1 <> idx) AS rerank_moved FROM (
           SELECT h.query_id, h.idx, row_number() OVER (PARTITION BY h.query_id ORDER BY h.hit) AS rank
           FROM hits h JOIN listed l ON h.query_id = l.query_id AND h.idx = l.rank - 1) WHERE rank <= 5 GROUP BY 1
         UNION ALL SELECT DISTINCT query_id, 0 FROM listed WHERE query_id LIKE '%:0'""",
)
def rerank_moved(t: Tables) -> DataFrame:
    rows = listed(t)
    return apply_hits(rows, hits(rows)).groupBy("query_id").agg(F.count_if("moved").alias("rerank_moved"))


@query(
    "j06_upsert_conflict",
    with_(TURNS_SQL)
    + """SELECT project_id, id, content FROM spoken UNION ALL
         SELECT 'user', doc_id || '#0', text FROM documents d
         WHERE NOT EXISTS (SELECT 1 FROM spoken o WHERE o.project_id = 'user' AND o.id = d.doc_id || '#0')""",
)
def upsert_conflict(t: Tables) -> DataFrame:
    return upsert(notes(t, "#0"), spoken(t))


@query(
    "j07_delete_by_id",
    """SELECT 'user' AS project_id, doc_id::VARCHAR AS id, text AS content FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def delete_by_id(t: Tables) -> DataFrame:
    listed_ids = t.read("labels").select(F.lit("user").alias("project_id"), F.col("doc_id").cast("string").alias("id"))
    return delete(notes(t), listed_ids)


@query(
    "j08_query_corpus_similarity",
    with_(VECTORS_SQL)
    + f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
              SELECT q.query_id, p.id, {cosine_sql('q.qvec', 'p.embedding')} AS score
              FROM vector_queries q JOIN vectors p ON q.project_id = p.project_id)) WHERE rank <= 40""",
)
def query_corpus(t: Tables) -> DataFrame:
    return dense_topk(t.vectors, t.vector_queries).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "j09_ids_with_fetched_map",
    "SELECT doc_id::VARCHAR AS id, text AS content, source FROM documents WHERE lang <> 'es'",
)
def ids_with_map(t: Tables) -> DataFrame:
    """Spanish ids are listed but were not fetched."""
    page = F.floor(F.col("doc_id") / 100).alias("page_no")
    rows = t.documents.select("source", page, "lang", F.col("doc_id").cast("string").alias("id"), "text")
    listed_pages = rows.groupBy("source", "page_no").agg(F.collect_list(F.struct("id")).alias("vectors")).select(
        F.to_json(F.struct("vectors")).alias("page")
    )
    one = F.struct("id", F.struct("id", F.struct(F.col("text").alias("content"), "source").alias("metadata")))
    fetched = rows.where("lang <> 'es'").groupBy("source", "page_no").agg(F.map_from_entries(F.collect_list(one)).alias("vectors")).select(
        F.to_json(F.struct("vectors")).alias("page")
    )
    return id_and_vector_pages(listed_pages, fetched).select("id", "content", F.col("meta")["source"].alias("source"))


@query(
    "j10_project_exists",
    """SELECT doc_id, source IN (SELECT 'src' || (label * 2) FROM embeddings) AS known FROM documents""",
)
def project_exists(t: Tables) -> DataFrame:
    projects = t.embeddings.select(F.concat(F.lit("src"), (F.col("label") * 2).cast("string")).alias("project_id"))
    asked = t.documents.select("doc_id", F.col("source").alias("project_id"))
    known, unknown = with_known_projects(asked, projects)
    return known.select("doc_id", F.lit(True).alias("known")).unionByName(unknown.select("doc_id", F.lit(False).alias("known")))


@query(
    "j11_lexical_match",
    with_(POINTS_SQL, QUESTIONS_SQL, MATCHES_SQL) + "SELECT query_id, id, lex_score FROM matches",
)
def lexical_match(t: Tables) -> DataFrame:
    return lexical_matches(t.questions, t.indexed).select("query_id", "id", "lex_score")


@query(
    "j11_lexical_match_postings",
    with_(POINTS_SQL, QUESTIONS_SQL, MATCHES_SQL) + "SELECT query_id, id, lex_score FROM matches",
)
def lexical_match_postings(t: Tables) -> DataFrame:
    return lexical_matches(t.questions, postings=build_postings(t.indexed)).select("query_id", "id", "lex_score")


@query(
    "j12_response_reordering",
    """SELECT vec_id // 128 AS batch_id, row_number() OVER (PARTITION BY vec_id // 128 ORDER BY vec_id) - 1 AS pos,
         round(embedding[1], 6) AS x FROM embeddings""",
)
def response_order(t: Tables) -> DataFrame:
    """Responses of at most 128 vectors each."""
    response = t.embeddings.select(F.floor(F.col("vec_id") / 128).alias("batch_id"), F.col("vec_id").alias("idx"), "embedding")
    return by_returned_index(response).select("batch_id", F.posexplode("ordered").alias("pos", "o")).select(
        "batch_id", F.col("pos").cast("long").alias("pos"), F.round(F.get("o.embedding", F.lit(0)), 6).alias("x")
    )


@query("u01_set_difference", with_(EDITED_SQL) + "SELECT source AS project_id, 'doc_' || doc_id || '.txt' AS source_file FROM documents EXCEPT ALL SELECT project_id, source_file FROM edited")
def set_difference(t: Tables) -> DataFrame:
    before = t.files.select("project_id", F.col("rel_path").alias("source_file"))
    after = t.files_of(t.edited_documents).select("project_id", F.col("rel_path").alias("source_file"))
    return before.exceptAll(after)


@query("u02_union_new_over_old", BOTH_SQL + """SELECT project_id, id, content_hash FROM fresh UNION ALL SELECT o.project_id, o.id, o.content_hash FROM chunks o
       WHERE NOT EXISTS (SELECT 1 FROM fresh n WHERE n.project_id = o.project_id AND n.id = o.id)""")
def union_new_over_old(t: Tables) -> DataFrame:
    keep = ["project_id", "id", "content_hash"]
    return upsert(t.chunks.select(*keep), chunk_files(t.files_of(t.edited_documents)).select(*keep))


@query("u03_concatenated_pages", "SELECT 'page' AS kind, page_id AS key, html AS text FROM pages UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def concatenated(t: Tables) -> DataFrame:
    pages = t.read("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("key"), F.col("html").alias("text"))
    items = t.read("benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("key"), "text")
    return pages.unionByName(items)


@query("u04_distinct", "SELECT DISTINCT source AS project_id, lang FROM documents")
def distinct_rows(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("project_id"), "lang").distinct()
