"""Queries P01-P24: predicates and row-wise projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions import hashing, meta, paths, vectors
from satchel.functions.text import highlight, preview
from satchel.operators.points import export_documents
from satchel.operators.rerank import apply_hits
from satchel.plans.search import with_defaults
from satchel.plans.sync import known_hashes
from satchel.session import broadcast_if_small, staged
from workload.base import FILES_SQL, LOG_SQL, POINTS_SQL, QUESTIONS_RAW_SQL, SEARCH_SQL, VECTORS_SQL, Tables, chunks_sql, query, with_

CHUNKS_SQL = with_(FILES_SQL, chunks_sql())


@query("p01_project_isolation", CHUNKS_SQL + "SELECT project_id, id, content FROM chunks WHERE project_id = 'src3'")
def isolation(t: Tables) -> DataFrame:
    return t.points.where(F.col("project_id") == "src3").select("project_id", "id", "content")


@query(
    "p02_metadata_filter",
    CHUNKS_SQL + "SELECT project_id, id FROM chunks WHERE source_dir = 'fr' AND position = 0",
)
def metadata_filter(t: Tables) -> DataFrame:
    wanted = {"source_dir": "fr", "chunk_index": "0", "embed_model": "hash-64"}
    return t.points.where(meta.meta_matches(wanted)).select("project_id", "id")


@query("p03_metadata_extract", "SELECT event_id, (props->>'$.k') AS k FROM events")
def metadata_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("p04_preview", "SELECT doc_id, substr(text, 1, 200) AS preview FROM documents")
def previews(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", preview(F.col("text")).alias("preview"))


@query("p05_string_metadata", "SELECT doc_id, source, lang, 2 AS n_kept FROM documents")
def string_metadata(t: Tables) -> DataFrame:
    payload = F.to_json(
        F.struct("source", "lang", "n_chars", F.lit(True).alias("flag"), F.struct("doc_id").alias("nested"))
    )
    kept = t.documents.select("doc_id", meta.string_entries_of_json(payload).alias("m"))
    return kept.select(
        "doc_id", F.col("m")["source"].alias("source"), F.col("m")["lang"].alias("lang"), F.size("m").alias("n_kept")
    )


@query(
    "p06_export_identity",
    CHUNKS_SQL + "SELECT project_id, CASE WHEN source_dir = 'en' THEN 'orig-' || content_hash ELSE id END AS id, content_hash FROM chunks",
)
def export_identity(t: Tables) -> DataFrame:
    named = t.points.withColumn(
        "doc_id", F.when(F.col("source_dir") == "en", F.concat(F.lit("orig-"), "content_hash")).otherwise("")
    )
    return export_documents(named).select("project_id", "id", F.col("meta")["content_hash"].alias("content_hash"))


@query(
    "p07_reconcile_key",
    CHUNKS_SQL
    + """SELECT project_id, CASE WHEN source_dir = 'en' THEN 'orig-' || content_hash ELSE id END AS id, content_hash
         FROM chunks WHERE source_dir <> 'es'""",
)
def reconcile_key(t: Tables) -> DataFrame:
    stored = t.points.withColumn(
        "doc_id", F.when(F.col("source_dir") == "en", F.concat(F.lit("orig-"), "content_hash"))
    ).withColumn("content_hash", F.when(F.col("source_dir") != "es", F.col("content_hash")).otherwise(""))
    return known_hashes(stored).select("project_id", "id", "content_hash")


@query("p08_chunk_id", CHUNKS_SQL + "SELECT id FROM chunks")
def chunk_ids(t: Tables) -> DataFrame:
    return t.chunks.select("id")


@query("p09_stored_content", CHUNKS_SQL + "SELECT id, content FROM chunks")
def stored_contents(t: Tables) -> DataFrame:
    return t.chunks.select("id", "content")


@query(
    "p10_metadata_map",
    CHUNKS_SQL
    + """SELECT id, source_file, source_dir, position::VARCHAR AS chunk_index, content_hash, 'v2' AS chunk_version, 5 AS n FROM chunks""",
)
def metadata_map(t: Tables) -> DataFrame:
    built = t.chunks.select(
        "id", meta.chunk_meta(F.col("source_file"), F.col("source_dir"), F.col("position"), F.col("content_hash")).alias("m")
    )
    keys = ("source_file", "source_dir", "chunk_index", "content_hash", "chunk_version")
    return built.select("id", *[F.col("m")[k].alias(k) for k in keys], F.size("m").alias("n"))


@query(
    "p11_provenance",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'own' ELSE 'voyage' END AS embed_model, '3' AS embed_dim, role AS type
       FROM conversations""",
)
def provenance(t: Tables) -> DataFrame:
    own = F.when(
        F.col("role") == "user", F.create_map(F.lit("type"), F.col("role"), F.lit("embed_model"), F.lit("own"))
    ).otherwise(F.create_map(F.lit("type"), F.col("role")))
    merged = meta.merge_caller_wins(meta.provenance("voyage", F.lit(3)), own)
    return t.read("conversations").select("conv_id", "turn", merged.alias("m")).select(
        "conv_id", "turn", *[F.col("m")[k].alias(k) for k in ("embed_model", "embed_dim", "type")]
    )


@query(
    "p12_generated_id",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE lower(hex(encode(text))) END AS id FROM documents",
)
def generated_id(t: Tables) -> DataFrame:
    given = F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise("")
    return t.documents.select("doc_id", hashing.document_id(given, F.col("text"), "hex").alias("id"))


@query(
    "p13_point_uuid",
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
         substr('89ab', (('0x' || substr(h, 17, 1))::INTEGER % 4 + 1)::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
       FROM (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc_' || doc_id)) AS h FROM documents)
       UNION ALL SELECT -1 - doc_id, '6ba7b811-9dad-11d1-80b4-' || lpad(doc_id::VARCHAR, 12, '0') FROM documents""",
)
def point_uuid(t: Tables) -> DataFrame:
    plain = t.documents.select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("raw"))
    ready = t.documents.select(
        (F.lit(-1) - F.col("doc_id")).alias("doc_id"),
        F.concat(F.lit("6ba7b811-9dad-11d1-80b4-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("raw"),
    )
    return plain.unionByName(ready).select("doc_id", hashing.point_uuid(F.col("raw")).alias("id"))


@query(
    "p14_collection_name",
    """SELECT page_id, 'project_' || coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g'), ''), 'x') AS name FROM pages
       UNION ALL SELECT -1 - page_id, 'project_' || substr(sha256('!' || repeat('?', 1 + page_id::INTEGER)), 1, 16) FROM pages""",
)
def collection_names(t: Tables) -> DataFrame:
    pages = t.read("pages")
    plain = pages.select("page_id", hashing.collection_name(F.col("url")).alias("name"))
    symbols = F.concat(F.lit("!"), F.repeat(F.lit("?"), (F.col("page_id") + 1).cast("int")))
    # The longest names stand next to each other, so they are dealt out.
    dealt = pages.select("page_id").repartition(4 * t.spark.sparkContext.defaultParallelism, "page_id")
    odd = dealt.select((F.lit(-1) - F.col("page_id")).alias("page_id"), hashing.collection_name(symbols).alias("name"))
    return plain.unionByName(odd)


@query(
    "p15_indexable",
    """SELECT doc_id, lang IN ('en', 'fr', 'es') AS indexable FROM documents""",
)
def indexable(t: Tables) -> DataFrame:
    name = (
        F.when(F.col("lang") == "en", F.lit("Notes.TXT"))
        .when(F.col("lang") == "fr", F.lit("Makefile"))
        .when(F.col("lang") == "es", F.lit(".gitignore"))
        .otherwise(F.concat(F.lit("photo"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    )
    return t.documents.select("doc_id", paths.is_indexable(name).alias("indexable"))


@query(
    "p16_size_limit",
    """SELECT doc_id, n_bytes FROM (SELECT doc_id, strlen(text) * 40 AS n_bytes FROM documents) WHERE n_bytes BETWEEN 1 AND 512000""",
)
def size_limit(t: Tables) -> DataFrame:
    sized = t.documents.select("doc_id", (F.octet_length("text") * 40).cast("long").alias("n_bytes"))
    return sized.where(paths.has_usable_size(F.col("n_bytes")))


@query(
    "p17_path_parts",
    """SELECT page_id, string_split(url, '/')[-1] AS base, replace('a\\' || url, '\\', '/') AS slashed FROM pages""",
)
def path_parts(t: Tables) -> DataFrame:
    return t.read("pages").select(
        "page_id",
        paths.base_name(F.col("url")).alias("base"),
        paths.slashed(F.concat(F.lit("a\\"), "url")).alias("slashed"),
    )


@query(
    "p18_option_defaults",
    """SELECT event_id, CASE WHEN k - 50 > 0 THEN k - 50 ELSE 5 END AS k, CASE WHEN k - 90 > 0 THEN k - 90 ELSE 40 END AS recall,
         coalesce(CASE WHEN event_type = 'click' THEN false END, true) AS hybrid, true AS rerank, false AS compress
       FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""",
)
def option_defaults(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    asked = t.events.select(
        "event_id", (k - 50).alias("k"), (k - 90).alias("recall"), F.when(F.col("event_type") == "click", F.lit(False)).alias("hybrid")
    )
    return with_defaults(asked)


@query(
    "p19_quantised_vectors",
    """SELECT vec_id, pos - 1 AS pos, round(x::DOUBLE, 6)::FLOAT::DOUBLE AS x FROM (
         SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
)
def quantised(t: Tables) -> DataFrame:
    parts = t.embeddings.select("vec_id", F.posexplode(vectors.quantise(F.col("embedding"))).alias("pos", "x"))
    return parts.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


@query(
    "p20_widened_vectors",
    "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
)
def widened(t: Tables) -> DataFrame:
    total = F.aggregate(vectors.widen(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return t.embeddings.select("vec_id", F.round(total, 6).alias("total"))


@query(
    "p21_score_band",
    """SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 'good' WHEN value / 100 >= 0.5 THEN 'warn' ELSE 'faint' END AS band FROM events""",
)
def bands(t: Tables) -> DataFrame:
    return t.events.select("event_id", meta.score_band(F.col("value") / 100).alias("band"))


@query(
    "p22_highlight",
    with_(QUESTIONS_RAW_SQL)
    + """SELECT query_id, CASE WHEN len(w) = 0 THEN text ELSE
           regexp_replace(text, '(' || array_to_string(list_transform(w, lambda x: regexp_escape(x)), '|') || ')', '<mark>\\1</mark>', 'gi') END AS marked
         FROM (SELECT q.query_id, d.text, list_filter(string_split_regex(lower(q.query), '\\s+'), lambda x: length(x) > 1) AS w
               FROM questions_raw q JOIN documents d ON split_part(q.query_id, ':', 1) = d.doc_id::VARCHAR)""",
)
def highlighted(t: Tables) -> DataFrame:
    texts = t.documents.select(F.col("doc_id").cast("string").alias("item"), "text")
    asked = t.questions.select("query_id", "query", F.substring_index("query_id", ":", 1).alias("item"))
    return texts.join(broadcast_if_small(asked), "item").select("query_id", highlight(F.col("text"), F.col("query")).alias("marked"))


@query(
    "p23_display_defaults",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN '(unknown)' ELSE lang END AS file, CASE WHEN lang = 'fr' THEN 'snippet' ELSE lang END AS type
       FROM documents""",
)
def display_defaults(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        meta.shown_file(F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))).alias("file"),
        meta.shown_type(F.when(F.col("lang") != "fr", F.col("lang"))).alias("type"),
    )


LISTED_SQL = SEARCH_SQL + """,
listed AS (SELECT query_id, id, score, rank FROM fused),
hits AS (SELECT query_id, rank - 1 AS hit, (rank * 7) % 61 - 5 AS idx, 1.0 / rank AS relevance_score FROM listed WHERE query_id NOT LIKE '%:0')"""


def listed(t: Tables) -> DataFrame:
    """The candidates of all questions, in their order; a question gets as
    many as its recall."""
    from satchel.plans.search import candidates

    found = candidates(t.questions, t.indexed).select("query_id", "id", "score", "rank", F.lit(5).alias("k"))
    # Read several times by what applies hits to them.
    return staged(found, "listed")


def hits(rows: DataFrame) -> DataFrame:
    """Rerank hits in a scrambled order, some of them out of range; none for
    the first clauses."""
    return rows.where(~F.col("query_id").endswith(":0")).select(
        "query_id",
        (F.col("rank") - 1).alias("hit"),
        (F.col("rank") * 7 % 61 - 5).alias("idx"),
        (F.lit(1.0) / F.col("rank")).alias("relevance_score"),
    )


@query(
    "p24_hits_in_range",
    with_(LISTED_SQL)
    + """SELECT h.query_id, count(*) AS n FROM hits h JOIN listed l ON h.query_id = l.query_id AND h.idx = l.rank - 1 GROUP BY 1""",
)
def hits_in_range(t: Tables) -> DataFrame:
    rows = listed(t).withColumn("k", F.lit(40))
    return apply_hits(rows, hits(rows)).where("reranked").groupBy("query_id").agg(F.count("*").alias("n"))


__all__ = ["LOG_SQL", "POINTS_SQL", "VECTORS_SQL"]
