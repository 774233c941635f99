"""Queries E01-E07, N01-N02, X03, X04, X09: embedding, indexes, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.ann import approximate_topk, assign_cells, train_cells
from satchel.operators.dense import dense_topk
from satchel.operators.embedding import embed
from satchel.operators.lexical import build_postings
from satchel.operators.points import export_documents, to_points
from satchel.operators.rerank import apply_hits, rerank_with, term_overlap
from satchel.plans.context import contexts, presented
from satchel.plans.search import embed_queries, search
from workload.base import (
    DENSE_SQL, MODEL, POINTS_SQL, QUESTIONS_SQL, SEARCH_SQL, VECTORS_SQL, Tables, compressed_sql, cosine_sql, query, with_,
)
from workload.projections import LISTED_SQL, listed


def shape_embedder(texts: Sequence[str]) -> tuple[list[list[float]], int]:
    """A stand-in model: length, spaces and letters e of a text."""
    made = [[float(len(s)), float(s.count(" ")), float(s.count("e"))] for s in texts]
    return made, sum(len(s) for s in texts)


def reversed_embedder(texts: Sequence[str]) -> list[list[float]]:
    """The query side of the stand-in model."""
    return [[float(s.count("e")), float(s.count(" ")), float(len(s))] for s in texts]


SHAPE_SQL = "length({0})::DOUBLE AS {1}, (length({0}) - length(replace({0}, ' ', '')))::DOUBLE AS spaces, (length({0}) - length(replace({0}, 'e', '')))::DOUBLE AS {2}"


@query("e01_embed_stage", "SELECT conv_id, turn, " + SHAPE_SQL.format("text", "len", "es") + " FROM conversations")
def embed_stage(t: Tables) -> DataFrame:
    made = embed(t.read("conversations"), shape_embedder, text="text", batch_size=32, counts_tokens=True)
    x = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    return made.select("conv_id", "turn", x[0].alias("len"), x[1].alias("spaces"), x[2].alias("es"))


@query(
    "e02_query_embedder",
    "SELECT item_id::VARCHAR AS query_id, " + SHAPE_SQL.format("text", "x2", "x0") + " FROM benchmark",
)
def query_embedder(t: Tables) -> DataFrame:
    asked = t.read("benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    made = embed_queries(asked, query_fn=reversed_embedder)
    x = [F.get("qvec", F.lit(i)).cast("double") for i in range(3)]
    return made.select("query_id", x[0].alias("x0"), x[1].alias("spaces"), x[2].alias("x2"))


def shortest_first(question: str, texts: Sequence[str], k: int) -> list[tuple[int, float]]:
    """A stand-in reranker; it fails on first clauses."""
    if question.endswith(":0"):
        raise RuntimeError("model not available")
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i]))
    return [(i, 1.0 / (1 + n)) for n, i in enumerate(order[:k])]


@query(
    "e03_reranker",
    with_(LISTED_SQL)
    + """SELECT query_id, id, rank, score FROM (
           SELECT query_id, id, r AS rank, 1.0::DOUBLE / r AS score FROM (
             SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY length(id), id) AS r FROM listed WHERE query_id NOT LIKE '%:0'))
         WHERE rank <= 5 UNION ALL SELECT query_id, id, rank, score FROM listed WHERE query_id LIKE '%:0' AND rank <= 5""",
)
def reranker(t: Tables) -> DataFrame:
    rows = listed(t).withColumn("content", F.col("id")).withColumn("query", F.col("query_id"))
    return apply_hits(rows, rerank_with(rows, shortest_first)).select("query_id", "id", "rank", "score")


@query("e04_token_counter", "SELECT sum(length(text))::BIGINT AS tokens FROM conversations")
def token_counter(t: Tables) -> DataFrame:
    made = embed(t.read("conversations"), shape_embedder, text="text", counts_tokens=True)
    return made.agg(F.sum("tokens").alias("tokens"))


@query(
    "e05_model_name",
    "SELECT conv_id, turn, 'shape-3' AS named, 'unknown' AS unnamed, '3' AS embed_dim FROM conversations",
)
def model_name(t: Tables) -> DataFrame:
    rows = t.read("conversations").select(
        F.lit("p").alias("project_id"), F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("content"), F.create_map().cast("map<string,string>").alias("meta"),
    )
    made = embed(rows, shape_embedder, counts_tokens=True)
    named, unnamed = to_points(made, "shape-3"), to_points(made)
    both = named.select("id", F.col("embed_model").alias("named"), F.col("meta")["embed_dim"].alias("embed_dim")).join(
        unnamed.select("id", F.col("embed_model").alias("unnamed")), "id"
    )
    parts = F.split("id", "#")
    return both.select(
        parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), "named", "unnamed", "embed_dim"
    )


@query("e06_exporter", with_(POINTS_SQL) + "SELECT project_id, id, content, 7 AS n_meta FROM points")
def exporter(t: Tables) -> DataFrame:
    return export_documents(t.points).select("project_id", "id", "content", F.size("meta").alias("n_meta"))


@query(
    "e07_hybrid_flag",
    with_(SEARCH_SQL)
    + """SELECT query_id, id, rank, in_dense OR in_lexical AS has_origin FROM fused WHERE length(query_id) % 2 = 1 AND rank <= 5
         UNION ALL SELECT query_id, id, rank, false FROM dense WHERE length(query_id) % 2 = 0 AND rank <= 5""",
)
def hybrid_flag(t: Tables) -> DataFrame:
    """Questions with an id of even length ask for dense search only."""
    asked = t.questions.withColumn("hybrid", F.char_length("query_id") % 2 == 1).withColumn("compress", F.lit(False))
    return search(asked, t.indexed).results.select(
        "query_id", "id", "rank", (F.col("in_dense") | F.col("in_lexical")).alias("has_origin")
    )


EXACT_SQL = f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT q.query_id, p.id, {cosine_sql('q.qvec', 'p.embedding')} AS score
    FROM vector_queries q JOIN vectors p ON q.project_id = p.project_id)) WHERE rank <= 40"""


@query("n01_cells_all_probed", with_(VECTORS_SQL) + EXACT_SQL)
def all_probed(t: Tables) -> DataFrame:
    cells = train_cells(t.vectors, 16)
    found = approximate_topk(assign_cells(t.vectors, cells), t.vector_queries, cells, probes=16)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("n01_cells_four_probed")
def four_probed(t: Tables) -> DataFrame:
    cells = train_cells(t.vectors, 16)
    found = approximate_topk(assign_cells(t.vectors, cells), t.vector_queries, cells, probes=4)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "n02_postings",
    with_(POINTS_SQL)
    + """SELECT project_id, id, term, count(*) AS tf, min(pos) AS first_at, max(pos) AS last_at FROM (
           SELECT project_id, id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos FROM points) GROUP BY ALL""",
)
def postings(t: Tables) -> DataFrame:
    return build_postings(t.points).select(
        "project_id", "id", "term", "tf", F.get("positions", F.lit(0)).cast("long").alias("first_at"),
        F.element_at("positions", -1).cast("long").alias("last_at"),
    )


# Rerank by the share of the question's words found, cut to 5, compress.
RERANKED_SQL = """full_rows AS (
  SELECT f.*, p.content, p.content_hash, p.source_file, q.query,
         CASE WHEN len(q.terms) = 0 THEN 0 ELSE len(list_filter(q.terms, lambda w: list_contains(p.words, w))) / len(q.terms) END AS overlap
  FROM fused f JOIN points p ON f.project_id = p.project_id AND f.id = p.id JOIN questions q ON f.query_id = q.query_id),
reranked AS (
  SELECT * EXCLUDE (rank, score), rank - 1 AS idx, overlap::DOUBLE AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS rank FROM full_rows QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) <= 5)"""

SEARCHED_SQL = with_(SEARCH_SQL, RERANKED_SQL, compressed_sql("reranked"))


def searched_by(t: Tables, points: DataFrame, **options):
    scorer = term_overlap(F.col("query"), F.col("content"))
    return search(t.questions, points, scorer=scorer, extra=("source_file", "meta"), **options)


def searched(t: Tables):
    return searched_by(t, t.indexed)


@query(
    "x03_search",
    SEARCHED_SQL + "SELECT query_id, id, rank, round(score, 6) AS score, in_dense, in_lexical, content_hash FROM compressed",
)
def full_search(t: Tables) -> DataFrame:
    return searched(t).results.select(
        "query_id", "id", "rank", F.round("score", 6).alias("score"), "in_dense", "in_lexical", "content_hash"
    )


@query(
    "x03_search_composition",
    SEARCHED_SQL
    + """SELECT q.query_id, true AS hybrid, c.n > 0 AS reranked, c.n AS candidates, r.n AS results, c.d AS dense_count, c.l AS lexical_count, m.n AS rerank_moved
         FROM questions q
         JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE in_dense) AS d, count(*) FILTER (WHERE in_lexical) AS l FROM fused GROUP BY 1) c ON q.query_id = c.query_id
         JOIN (SELECT query_id, count(*) AS n FROM compressed GROUP BY 1) r ON q.query_id = r.query_id
         JOIN (SELECT query_id, count(*) FILTER (WHERE rank - 1 <> idx) AS n FROM reranked GROUP BY 1) m ON q.query_id = m.query_id""",
)
def search_composition(t: Tables) -> DataFrame:
    return searched(t).composition()


@query(
    "x03_dense_only_search",
    with_(POINTS_SQL, QUESTIONS_SQL, DENSE_SQL) + "SELECT query_id, id, rank, round(score, 6) AS score FROM dense WHERE rank <= 5",
)
def dense_only(t: Tables) -> DataFrame:
    asked = t.questions.withColumn("hybrid", F.lit(False)).withColumn("compress", F.lit(False))
    return search(asked, t.indexed).results.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(
    "x04_retrieve_context",
    SEARCHED_SQL
    + """SELECT query_id, string_agg(printf('[score %.3f] %s', score, content), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_results
         FROM compressed GROUP BY 1""",
)
def retrieve_context(t: Tables) -> DataFrame:
    return contexts(t.questions, searched(t).results)


@query(
    "x09_presented_results",
    SEARCHED_SQL
    + """SELECT query_id, rank, score, CASE WHEN score >= 0.75 THEN 'good' WHEN score >= 0.5 THEN 'warn' ELSE 'faint' END AS band,
           CASE WHEN len(w) = 0 THEN s ELSE regexp_replace(s, '(' || array_to_string(list_transform(w, lambda x: regexp_escape(x)), '|') || ')', '<mark>\\1</mark>', 'gi') END AS snippet,
           source_file AS file, 'snippet' AS type
         FROM (SELECT query_id, rank, round(score, 6) AS score, substr(content, 1, 200) AS s, source_file,
                      list_filter(string_split_regex(lower(query), '\\s+'), lambda x: length(x) > 1) AS w FROM compressed)""",
)
def presentation(t: Tables) -> DataFrame:
    return presented(searched(t).results, t.questions).withColumn("score", F.round("score", 6))


__all__ = ["MODEL", "dense_topk"]
