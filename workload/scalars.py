"""Queries F01-F18: scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions import hashing, paths, text, vectors
from satchel.operators.fusion import rrf_share
from satchel.operators.points import dimensions
from satchel.plans.context import context_line
from workload.base import (
    FILES_SQL, LOG_SQL, POINTS_SQL, QUESTIONS_SQL, VECTORS_SQL, Tables, chunks_sql, cosine_sql, query, tokens_sql, with_,
)


@query("f01_chunk_text", with_(FILES_SQL, chunks_sql()) + "SELECT id, position, chunk FROM chunks")
def chunk_text(t: Tables) -> DataFrame:
    return t.chunks.select("id", F.col("position").cast("long").alias("position"), "chunk")


@query("f01_chunk_text_small", with_(FILES_SQL, chunks_sql(size=97)) + "SELECT id, position, chunk FROM chunks")
def chunk_text_small(t: Tables) -> DataFrame:
    from satchel.operators.chunking import chunk_files

    return chunk_files(t.files, 97).select("id", F.col("position").cast("long").alias("position"), "chunk")


@query("f02_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.content_hash(F.col("text")).alias("digest"))


@query(
    "f03_cosine",
    f"""SELECT a.vec_id, round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS score
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(t: Tables) -> DataFrame:
    """Each vector next to its successor."""
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t.embeddings.join(after, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("score")
    )


@query("f04_score_from_distance", "SELECT event_id, round(1 - value / 1000, 6) AS score FROM events")
def score_from_distance(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(vectors.score_from_distance(F.col("value") / 1000), 6).alias("score"))


@query(
    "f05_tokens",
    f"""SELECT doc_id, word, count(*) AS tf, min(pos) AS first_at FROM (
          SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents))
        GROUP BY ALL""",
)
def tokens(t: Tables) -> DataFrame:
    # Texts are dealt out, not their words: a text is a fraction of its counted words.
    words = t.documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_at"))


@query("f06_query_terms", with_(QUESTIONS_SQL) + "SELECT query_id, len(terms) AS n, array_to_string(list_sort(terms), ' ') AS words FROM questions")
def query_terms(t: Tables) -> DataFrame:
    terms = text.query_terms(F.col("query"))
    return t.questions.select(
        "query_id", F.size(terms).cast("long").alias("n"), F.array_join(F.array_sort(terms), " ").alias("words")
    )


@query(
    "f07_term_frequency_score",
    with_(POINTS_SQL, QUESTIONS_SQL)
    + """SELECT q.query_id, p.id, len(list_filter(p.words, lambda t: list_contains(q.terms, t))) AS lex_score
         FROM questions q JOIN points p ON q.project_id = p.project_id WHERE len(q.terms) > 0 AND list_has_all(p.words, q.terms)""",
)
def term_frequency(t: Tables) -> DataFrame:
    from satchel.operators.lexical import lexical_matches

    return lexical_matches(t.questions, t.indexed).select("query_id", "id", "lex_score")


@query(
    "f08_rank_fusion",
    """SELECT event_id, round(coalesce(1.0::DOUBLE / (60 + d), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 9) AS score FROM (
         SELECT event_id, CASE WHEN event_type <> 'click' THEN k END AS d, CASE WHEN event_type <> 'view' THEN k + 1 END AS l
         FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))""",
)
def rank_fusion(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ranks = t.events.select(
        "event_id", F.when(F.col("event_type") != "click", k).alias("d"), F.when(F.col("event_type") != "view", k + 1).alias("l")
    )
    return ranks.select("event_id", F.round(rrf_share(F.col("d")) + rrf_share(F.col("l")), 9).alias("score"))


@query("f09_context_line", "SELECT event_id, printf('[score %.3f] %s', value, event_type) AS line FROM events")
def line(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("value").alias("score"), F.col("event_type").alias("content"))
    return rows.select("event_id", context_line().alias("line"))


@query("f10_latency_ms", "SELECT event_id, round((value * 1000)::BIGINT / 1000.0, 3) AS latency_ms FROM events")
def latency(t: Tables) -> DataFrame:
    micros = F.round(F.col("value") * 1000).cast("long")
    return t.events.select("event_id", F.round(micros / 1000.0, 3).alias("latency_ms"))


@query("f11_epoch_seconds", "SELECT event_id, floor(epoch(ts))::BIGINT AS epoch_s FROM events")
def epoch(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("epoch_s"))


@query("f12_boolean_as_number", with_(LOG_SQL) + "SELECT event_id, hybrid::INTEGER AS hybrid, reranked::INTEGER AS reranked FROM query_log")
def boolean_number(t: Tables) -> DataFrame:
    return t.query_log.select("event_id", F.col("hybrid").cast("int").alias("hybrid"), F.col("reranked").cast("int").alias("reranked"))


@query(
    "f13_null_handling",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, nullif(d.lang, 'en') AS other_lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def null_handling(t: Tables) -> DataFrame:
    return t.documents.join(t.read("labels"), "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.col("lang"), F.lit("en")).alias("other_lang")
    )


@query("f14_dimensions", with_(VECTORS_SQL) + "SELECT project_id, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(*) AS points FROM vectors GROUP BY 1")
def dims(t: Tables) -> DataFrame:
    found = dimensions(t.vectors.withColumn("embed_dim", vectors.dimension(F.col("embedding"))))
    return found.select("project_id", F.col("min_dim").cast("long").alias("min_dim"), F.col("max_dim").cast("long").alias("max_dim"), "points")


@query(
    "f15_truncated_dimension",
    """SELECT vec_id, len(h) AS dim, round(h[1] / sqrt(list_dot_product(h, h)), 5) AS x0, round(h[16] / sqrt(list_dot_product(h, h)), 5) AS x15
       FROM (SELECT vec_id, embedding[1:16]::DOUBLE[] AS h FROM embeddings)""",
)
def truncated(t: Tables) -> DataFrame:
    cut = t.embeddings.select("vec_id", vectors.truncate_dim(F.col("embedding"), 16).alias("v"))
    return cut.select(
        "vec_id", F.size("v").cast("long").alias("dim"),
        F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("x0"), F.round(F.get("v", F.lit(15)).cast("double"), 5).alias("x15"),
    )


@query("f16_extension", "SELECT page_id, lower(regexp_extract(string_split(url, '/')[-1], '(\\.[^.]*)$', 1)) AS ext, string_split(url, '/')[-1] AS base FROM pages")
def extension(t: Tables) -> DataFrame:
    base = paths.base_name(F.col("url"))
    return t.read("pages").select("page_id", paths.extension(base).alias("ext"), base.alias("base"))


@query("f17_collection_prefix", "SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS project_id FROM documents")
def prefix(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("lang") == "en", F.lit("project_")).otherwise(F.lit("other_")), "source")
    return t.documents.select("doc_id", hashing.project_of_collection(name).alias("project_id"))


@query("f18_content_hex", "SELECT item_id, lower(hex(encode(text))) AS hex FROM benchmark")
def content_hex(t: Tables) -> DataFrame:
    return t.read("benchmark").select("item_id", hashing.content_hex(F.col("text")).alias("hex"))
