"""Queries S01-S13: reading files, documents, stores and exported pages."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.hashing import collection_name, project_of_collection
from satchel.functions.paths import outside_skipped_dirs
from satchel.operators.points import export_documents, list_points
from satchel.session import scratch_path
from satchel.sources.documents import documents
from satchel.sources.files import list_tree, read_files
from satchel.sources.imports import import_documents, parallel_array_pages
from satchel.sources.store import PointStore
from satchel.streaming.events import append_to, follow, of_types, publish, record_queries
from workload.base import FILES_SQL, LOG_SQL, POINTS_SQL, Tables, query, trial_store, with_


def tree_path() -> F.Column:
    """Where a document lies in the trial tree: German ones in a skipped
    folder, Spanish ones with an extension that is not taken in, French ones
    with a leading underscore, English ones as dot-env files."""
    number = F.col("doc_id").cast("string")
    return (
        F.when(F.col("lang") == "de", F.concat("source", F.lit("/node_modules/d"), number, F.lit(".txt")))
        .when(F.col("lang") == "es", F.concat("source", F.lit("/d"), number, F.lit(".bin")))
        .when(F.col("lang") == "fr", F.concat("source", F.lit("/sub/_d"), number, F.lit(".md")))
        .otherwise(F.concat("source", F.lit("/d"), number, F.lit("/.env")))
    )


def write_tree(t: Tables) -> str:
    """Write every document as a file, from the tasks that hold the rows."""
    root = scratch_path(t.spark, "tree").removeprefix("file:")
    root = root if not root.startswith("//") else root[2:]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for path, text in zip(batch.column("p").to_pylist(), batch.column("text").to_pylist()):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as handle:
                    handle.write(text.encode("utf-8"))
                done += 1
        yield pa.RecordBatch.from_pydict({"done": pa.array([done], pa.int64())})

    t.documents.select(tree_path().alias("p"), "text").mapInArrow(write, "done long").agg(F.sum("done")).collect()
    return root


TREE_SQL = """SELECT CASE WHEN lang = 'fr' THEN source || '/sub/_d' || doc_id || '.md'
                          ELSE source || '/d' || doc_id || '/.env' END AS rel_path,
                     strlen(text)::BIGINT AS length{more}
              FROM documents WHERE lang IN ('en', 'fr')"""


@query("s01_tree_scan", TREE_SQL.format(more=", md5(CASE WHEN strlen(text) BETWEEN 1 AND 512000 THEN text END) AS digest"))
def tree_scan(t: Tables) -> DataFrame:
    files = read_files(t.spark, write_tree(t), "p")
    return files.select("rel_path", "length", F.md5("text").alias("digest"))


@query("s01_tree_listing", TREE_SQL.format(more=""))
def tree_listing(t: Tables) -> DataFrame:
    return list_tree(t.spark, write_tree(t)).select("rel_path", "length")


@query(
    "s02_skipped_directories",
    "SELECT doc_id, source || '/' || lang || '/x.txt' AS rel_path FROM documents WHERE lang <> 'de'",
)
def skipped_directories(t: Tables) -> DataFrame:
    folder = F.when(F.col("lang") == "de", F.lit("vendor")).otherwise(F.col("lang"))
    placed = t.documents.select("doc_id", F.concat_ws("/", "source", folder, F.lit("x.txt")).alias("rel_path"))
    return placed.where(outside_skipped_dirs(F.col("rel_path")))


@query(
    "s03_document_source",
    "SELECT conv_id || '#' || turn AS id, text AS content, role AS type FROM conversations",
)
def document_source(t: Tables) -> DataFrame:
    talk = t.read("conversations")
    rows = documents(
        talk,
        F.col("text"),
        F.concat_ws("#", F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        F.create_map(F.lit("type"), F.col("role")),
    )
    return rows.select("id", "content", F.col("meta")["type"].alias("type"))


def stored(t: Tables) -> PointStore:
    store = trial_store(t)
    store.upsert(t.points)
    return store


@query(
    "s04_project_scan",
    with_(POINTS_SQL)
    + """SELECT project_id, id, source_file, content_hash, 'v2' AS chunk_version, '' AS doc_id, substr(content, 1, 200) AS content,
         position::VARCHAR AS chunk_index FROM points WHERE project_id IN ('src0', 'src1')""",
)
def project_scan(t: Tables) -> DataFrame:
    return list_points(stored(t).points(["src0", "src1"]))


@query(
    "s05_full_export",
    with_(POINTS_SQL)
    + """SELECT project_id, id, content, source_file, source_dir, position::VARCHAR AS chunk_index, content_hash,
         'hash-64' AS embed_model, '64' AS embed_dim FROM points""",
)
def full_export(t: Tables) -> DataFrame:
    keys = ("source_file", "source_dir", "chunk_index", "content_hash", "embed_model", "embed_dim")
    return export_documents(stored(t).points()).select(
        "project_id", "id", "content", *[F.col("meta")[k].alias(k) for k in keys]
    )


@query("s06_catalogue_scan", "SELECT DISTINCT source AS project_id FROM documents")
def catalogue_scan(t: Tables) -> DataFrame:
    ours = t.documents.select(collection_name(F.col("source")).alias("name"))
    others = t.documents.select(F.col("lang").alias("name"))
    named = ours.unionByName(others).distinct()
    return named.select(project_of_collection(F.col("name")).alias("project_id")).where("project_id IS NOT NULL")


# Exported pages are made from the documents: one page per source and block of
# neighbouring numbers. Metadata mixes strings with numbers and nested values.


def _paged(t: Tables, size: int) -> DataFrame:
    return t.documents.select(
        "source", F.floor(F.col("doc_id") / size).alias("page_no"), F.col("doc_id").cast("string").alias("id"), "text",
        "lang", "n_chars",
    )


IMPORTED_SQL = "SELECT doc_id::VARCHAR AS id, text AS content, source, lang, NULL::VARCHAR AS n_chars FROM documents"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "content", *[F.col("meta")[k].alias(k) for k in ("source", "lang", "n_chars")])


def _meta() -> F.Column:
    return F.struct("source", "lang", "n_chars", F.struct("lang").alias("nested"), F.col("text").alias("content"))


@query("s07_vector_pages", IMPORTED_SQL)
def vector_pages(t: Tables) -> DataFrame:
    rows = _paged(t, 100)
    listed = rows.groupBy("source", "page_no").agg(F.collect_list(F.struct("id")).alias("vectors")).select(
        F.to_json(F.struct("vectors")).alias("page")
    )
    fetched = rows.groupBy("source", "page_no").agg(
        F.map_from_entries(F.collect_list(F.struct("id", F.struct("id", _meta().alias("metadata"))))).alias("vectors")
    ).select(F.to_json(F.struct("vectors")).alias("page"))
    return _shown(import_documents(fetched, "vectors", listed=listed))


@query("s08_nested_pages", IMPORTED_SQL)
def nested(t: Tables) -> DataFrame:
    one = F.struct(F.struct("id").alias("_additional"), "source", "lang", "n_chars", F.col("text").alias("content"))
    pages = _paged(t, 100).groupBy("source", "page_no").agg(F.collect_list(one).alias("Doc")).select(
        F.to_json(F.struct(F.struct(F.struct("Doc").alias("Get")).alias("data"))).alias("page")
    )
    return _shown(import_documents(pages, "nested"))


@query("s09_parallel_arrays", IMPORTED_SQL)
def arrays(t: Tables) -> DataFrame:
    """French texts come in the metadata field instead of the documents array."""
    row = F.struct("id", F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("text")).alias("document"), _meta().alias("m"))
    pages = _paged(t, 100).groupBy("source", "page_no").agg(F.collect_list(row).alias("rows")).select(
        F.to_json(
            F.struct(
                F.array(F.col("rows.id")).alias("ids"),
                F.array(F.col("rows.document")).alias("documents"),
                F.array(F.col("rows.m")).alias("metadatas"),
            )
        ).alias("page")
    )
    return _shown(import_documents(pages, "arrays"))


@query(
    "s09_ragged_arrays",
    "SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'en' THEN text ELSE '' END AS content, 0 AS n_meta FROM documents",
)
def ragged_arrays(t: Tables) -> DataFrame:
    """Pages that lack metadata, and beyond English texts also documents."""
    pages = _paged(t, 100).groupBy("source", "page_no", "lang").agg(F.collect_list(F.struct("id", "text")).alias("rows")).select(
        F.to_json(
            F.struct(
                F.array(F.col("rows.id")).alias("ids"),
                F.when(F.col("lang") == "en", F.array(F.col("rows.text"))).alias("documents"),
            )
        ).alias("page")
    )
    return parallel_array_pages(pages).select("id", "content", F.size("meta").alias("n_meta"))


def scroll(t: Tables) -> DataFrame:
    """Pages of at most 256 points; the payload of English ones has a doc_id."""
    doc_id = F.when(F.col("lang") == "en", F.concat(F.lit("orig-"), "id"))
    payload = F.struct(F.col("text").alias("content"), doc_id.alias("doc_id"), "source", "lang", "n_chars")
    return _paged(t, 256).groupBy("source", "page_no").agg(
        F.collect_list(F.struct("id", payload.alias("payload"))).alias("points")
    ).select(F.to_json(F.struct(F.struct("points").alias("result"))).alias("page"))


SCROLLED_SQL = """SELECT CASE WHEN lang = 'en' THEN 'orig-' || doc_id ELSE doc_id::VARCHAR END AS id, text AS content,
                  source, lang, NULL::VARCHAR AS n_chars FROM documents"""


@query("s10_scroll_pages", SCROLLED_SQL)
def scroll_import(t: Tables) -> DataFrame:
    return _shown(import_documents(scroll(t), "pages"))


@query(
    "s11_import_dispatch",
    """SELECT 'pages' AS layout, CASE WHEN lang = 'en' THEN 'orig-' || doc_id ELSE doc_id::VARCHAR END AS id, md5(text) AS content_md5 FROM documents
       UNION ALL SELECT 'nested', '', md5(text) FROM documents WHERE length(text) > 0""",
)
def import_dispatch(t: Tables) -> DataFrame:
    one = F.struct(F.struct("id").alias("_additional"), F.col("text").alias("body"))
    named_field = _paged(t, 100).groupBy("source", "page_no").agg(F.collect_list(one).alias("Doc")).select(
        F.to_json(F.struct(F.struct(F.struct("Doc").alias("Get")).alias("data"))).alias("page")
    )
    by_layout = [
        import_documents(scroll(t), "pages").select(F.lit("pages").alias("layout"), "id", F.md5("content").alias("content_md5")),
        import_documents(named_field, "nested", "body").where(F.col("content") != "").select(
            F.lit("nested").alias("layout"), F.lit("").alias("id"), F.md5("content").alias("content_md5")
        ),
    ]
    return by_layout[0].unionByName(by_layout[1])


@query("s12_query_log_scan", with_(LOG_SQL) + "SELECT project_id, latency_ms, hybrid, reranked, candidates FROM query_log")
def query_log_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "query-log")
    record_queries(t.query_log, path)
    return t.spark.read.parquet(path).select("project_id", "latency_ms", "hybrid", "reranked", "candidates")


@query(
    "s13_event_subscription",
    "SELECT event_type AS type, user_id::VARCHAR AS project_id, props->>'$.k' AS candidates FROM events WHERE event_type IN ('click', 'view')",
)
def event_subscription(t: Tables) -> DataFrame:
    log, out = scratch_path(t.spark, "event-log"), scratch_path(t.spark, "followed")
    publish(t.event_log, log)
    stream = of_types(follow(t.spark, log), ["click", "view"])
    append_to(stream, out, scratch_path(t.spark, "ck"), once=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out).select("type", "project_id", F.col("data")["candidates"].alias("candidates"))


__all__ = ["FILES_SQL"]
