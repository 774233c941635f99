"""Registry of queries and the binding of the given tables to library rows.

Bindings: a document is a source file (project = its source, directory = its
language); a clause of a benchmark text is a question to the project of the
document with the same number; a vector belongs to the project named by its
label; an event is one logged query.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.operators.chunking import chunk_files
from satchel.plans.search import embed_queries, with_defaults
from satchel.plans.sync import chunk_points
from satchel.session import scratch_path, staged
from satchel.sources.files import files_from_table
from satchel.sources.store import PointStore

MODEL = "hash-64"
DIM = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``, with its SQL twin if it has one."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def _spread(self, df: DataFrame) -> DataFrame:
        """Share a scan of very few splits among the cores; a scan that has
        enough splits of its own is left without a shuffle."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def documents(self) -> DataFrame:
        return self._spread(self.read("documents"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self._spread(self.read("embeddings"))

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def files(self) -> DataFrame:
        return self.files_of(self.documents)

    @staticmethod
    def files_of(documents: DataFrame) -> DataFrame:
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return files_from_table(documents, F.col("source"), F.col("lang"), name, F.col("text"))

    @cached_property
    def edited_documents(self) -> DataFrame:
        """A later state of the corpus: documents labelled toxic are gone, those
        of low quality have grown by a line."""
        labels = self.read("labels")
        grown = F.when(F.col("quality") == 0, F.concat("text", F.lit("\nadded line"))).otherwise(F.col("text"))
        return (
            self.documents.join(labels, "doc_id", "left")
            .where(F.coalesce("toxic", F.lit(0)) == 0)
            .withColumn("text", grown)
            .drop("quality", "toxic")
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return chunk_files(self.files)

    @cached_property
    def points(self) -> DataFrame:
        return chunk_points(self.chunks, model=MODEL)

    @cached_property
    def indexed(self) -> DataFrame:
        """The points as a written table, as a store would hold them."""
        return staged(self.points, "indexed")

    @cached_property
    def questions(self) -> DataFrame:
        home = self.read("documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("project_id"))
        clauses = self.read("benchmark").join(home, "item_id").select(
            "item_id", "project_id", F.posexplode(F.split("text", "[.,]")).alias("pos", "query")
        )
        asked = clauses.where(F.trim("query") != "").select(
            F.concat_ws(":", F.col("item_id").cast("string"), F.col("pos").cast("string")).alias("query_id"),
            "project_id",
            "query",
            F.lit(True).alias("compress"),
        )
        return with_defaults(embed_queries(asked, DIM))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            F.col("label").cast("string").alias("project_id"), F.col("vec_id").cast("string").alias("id"), "embedding"
        )

    @cached_property
    def vector_queries(self) -> DataFrame:
        own = self.read("embeddings").withColumnRenamed("vec_id", "item_id")
        return self.read("benchmark").join(own, "item_id").select(
            F.col("item_id").cast("string").alias("query_id"),
            F.col("label").cast("string").alias("project_id"),
            F.col("embedding").alias("qvec"),
            F.lit(40).alias("recall"),
            F.lit(5).alias("k"),
        )

    @cached_property
    def query_log(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            "event_id",
            "ts",
            F.col("user_id").cast("string").alias("project_id"),
            F.col("value").alias("latency_ms"),
            (F.col("event_type") != "error").alias("hybrid"),
            (F.col("event_type") == "purchase").alias("reranked"),
            k.alias("candidates"),
            F.least(k, F.lit(5)).alias("results"),
            F.floor(k / 2).cast("int").alias("dense_count"),
            (k - F.floor(k / 2).cast("int")).alias("lexical_count"),
            F.floor(k / 10).cast("int").alias("rerank_moved"),
        )

    @cached_property
    def event_log(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("event_type").alias("type"),
            "ts",
            F.col("user_id").cast("string").alias("project_id"),
            F.create_map(F.lit("candidates"), F.get_json_object("props", "$.k")).alias("data"),
        )

    @cached_property
    def recorded_log(self) -> DataFrame:
        """The query log as a job writes it and a report reads it."""
        from satchel.streaming.events import record_queries

        path = scratch_path(self.spark, "query-log")
        record_queries(self.query_log, path)
        return self.spark.read.parquet(path)

    @cached_property
    def recorded_events(self) -> DataFrame:
        from satchel.streaming.events import publish

        path = scratch_path(self.spark, "event-log")
        publish(self.event_log, path)
        return self.spark.read.parquet(path)

    @cached_property
    def usage(self) -> DataFrame:
        """Tokens by stage: whole documents embedded, conversations reranked."""
        from satchel.functions.text import tokens

        def of(df: DataFrame, stage: str) -> DataFrame:
            return df.select(F.lit(stage).alias("stage"), F.size(tokens(F.col("text"))).cast("long").alias("tokens"))

        return of(self.documents, "embed").unionByName(of(self.read("conversations"), "rerank"))


def trial_store(t: Tables) -> PointStore:
    """An empty store in the scratch folder; few buckets, as the tables are small."""
    return PointStore(t.spark, scratch_path(t.spark, "store"), buckets=2)


def even(x: F.Column) -> F.Column:
    """A mean to six decimals. The nudge keeps exact halves, which sums in
    different order may leave on either side, rounding the same way."""
    return F.round(x + 1e-9, 6)


# ---------------------------------------------------------------- SQL twins

FILES_SQL = """files AS (
  SELECT source AS project_id, lang AS source_dir, 'doc_' || doc_id || '.txt' AS source_file,
         strlen(text) AS length, text, doc_id
  FROM documents)"""

EDITED_SQL = """edited AS (
  SELECT d.source AS project_id, d.lang AS source_dir, 'doc_' || d.doc_id || '.txt' AS source_file,
         CASE WHEN l.quality = 0 THEN d.text || chr(10) || 'added line' ELSE d.text END AS text, d.doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  WHERE coalesce(l.toxic, 0) = 0)"""


def chunks_sql(source: str = "files", name: str = "chunks", size: int = 1500) -> str:
    """CTEs that chunk the ``text`` of ``source`` by a fold over its lines."""
    full = f"a.cur <> '' AND length(a.cur) + length(b.l) + 1 > {size}"
    cuts = f"((length(b.l) - 1) // {size})"
    pieces = f"list_transform(range(0, {cuts}), lambda i: substr(b.l, (i * {size} + 1)::BIGINT, {size}))"
    opened = "CASE WHEN a.cur <> '' THEN [a.cur] ELSE []::VARCHAR[] END"
    return f"""{name}_folded AS (
  SELECT project_id, source_dir, source_file, text, list_reduce(
    list_prepend({{'c': []::VARCHAR[], 'cur': '', 'l': ''}},
      list_transform(string_split(text, chr(10)), lambda x: {{'c': []::VARCHAR[], 'cur': '', 'l': x}})),
    lambda a, b: {{
      'c': CASE WHEN length(b.l) > {size} THEN list_concat(list_concat(a.c, {opened}), {pieces})
                WHEN {full} THEN list_append(a.c, a.cur) ELSE a.c END,
      'cur': CASE WHEN length(b.l) > {size} THEN substr(b.l, {cuts} * {size} + 1) || chr(10)
                  WHEN {full} THEN b.l || chr(10) ELSE a.cur || b.l || chr(10) END,
      'l': ''}}) AS f
  FROM {source} WHERE strlen(text) BETWEEN 1 AND 512000),
{name}_lists AS (
  SELECT project_id, source_dir, source_file,
    CASE WHEN length(text) <= {size} THEN [text]
         ELSE list_concat(f.c, CASE WHEN f.cur <> '' THEN [f.cur] ELSE []::VARCHAR[] END) END AS parts
  FROM {name}_folded),
{name} AS (
  SELECT project_id, source_dir, source_file, position, chunk,
    source_dir || '/' || source_file || '#chunk' || position AS id,
    substr(sha256(chunk), 1, 16) AS content_hash,
    'File: ' || source_file || chr(10) || chr(10) || chunk AS content
  FROM (SELECT project_id, source_dir, source_file, unnest(parts) AS chunk,
               generate_subscripts(parts, 1) - 1 AS position FROM {name}_lists))"""


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def embedded_sql(source: str, text: str, name: str, vector: str = "embedding") -> str:
    """CTEs that add the hashed vector of ``text`` to the rows of ``source``."""
    return f"""{name}_b AS (
  SELECT *, {tokens_sql(text)} AS words FROM {source}),
{name}_h AS (
  SELECT *, list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM}) AS buckets FROM {name}_b),
{name}_n AS (
  SELECT *, list_transform(range(0, {DIM}), lambda i: len(list_filter(buckets, lambda b: b = i))) AS cnt FROM {name}_h),
{name} AS (
  SELECT * EXCLUDE (buckets, cnt), list_transform(cnt, lambda c: (CASE WHEN len(words) = 0 THEN 0
    ELSE c / sqrt(list_sum(list_transform(cnt, lambda x: x * x))) END)::FLOAT) AS {vector}
  FROM {name}_n)"""


POINTS_SQL = FILES_SQL + ",\n" + chunks_sql() + ",\n" + embedded_sql("chunks", "content", "points")

QUESTIONS_RAW_SQL = """questions_raw AS (
  SELECT item_id || ':' || pos AS query_id, project_id, query FROM (
    SELECT b.item_id, d.source AS project_id, unnest(string_split_regex(b.text, '[.,]')) AS query,
           generate_subscripts(string_split_regex(b.text, '[.,]'), 1) - 1 AS pos
    FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)
  WHERE trim(query, ' ') <> '')"""

QUESTIONS_SQL = (
    QUESTIONS_RAW_SQL + ",\n" + embedded_sql("questions_raw", "query", "questions_v", "qvec")
    + ",\nquestions AS (SELECT *, list_distinct(words) AS terms, 5 AS k, 40 AS recall FROM questions_v)"
)


def cosine_sql(a: str, b: str) -> str:
    """Cosine of two vectors; zero vectors score 0."""
    dot = f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    size = f"(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
    return f"round(CASE WHEN {size} = 0 THEN 0 ELSE {dot} / {size} END, 12)"


DENSE_SQL = f"""dense AS (
  SELECT * FROM (
    SELECT query_id, project_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT q.query_id, p.project_id, p.id, {cosine_sql('q.qvec', 'p.embedding')} AS score
          FROM questions q JOIN points p ON q.project_id = p.project_id))
  WHERE rank <= 40)"""

MATCHES_SQL = """matches AS (
  SELECT q.query_id, p.project_id, p.id,
         len(list_filter(p.words, lambda t: list_contains(q.terms, t))) AS lex_score
  FROM questions q JOIN points p ON q.project_id = p.project_id
  WHERE len(q.terms) > 0 AND list_has_all(p.words, q.terms))"""

LEXICAL_SQL = (
    MATCHES_SQL
    + """,
lexical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex_score DESC, id) AS rank FROM matches)
  WHERE rank <= 40)"""
)

FUSED_SQL = """fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.project_id, l.project_id) AS project_id,
             coalesce(d.id, l.id) AS id,
             coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS score,
             d.id IS NOT NULL AS in_dense, l.id IS NOT NULL AS in_lexical
      FROM dense d FULL OUTER JOIN lexical l ON d.query_id = l.query_id AND d.id = l.id))
  WHERE rank <= 40)"""

SEARCH_SQL = ",\n".join([POINTS_SQL, QUESTIONS_SQL, DENSE_SQL, LEXICAL_SQL, FUSED_SQL])

VECTORS_SQL = """vectors AS (SELECT label::VARCHAR AS project_id, vec_id::VARCHAR AS id, embedding FROM embeddings),
vector_queries AS (
  SELECT b.item_id::VARCHAR AS query_id, e.label::VARCHAR AS project_id, e.embedding AS qvec
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""

LOG_SQL = """query_log AS (
  SELECT event_id, ts, user_id::VARCHAR AS project_id, value AS latency_ms, event_type <> 'error' AS hybrid,
         event_type = 'purchase' AS reranked, k AS candidates, least(k, 5) AS results, k // 2 AS dense_count,
         k - k // 2 AS lexical_count, k // 10 AS rerank_moved
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))"""


def compressed_sql(source: str, name: str = "compressed") -> str:
    """Hash test first, text test among its survivors."""
    return f"""{name}_a AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS hn FROM {source}),
{name}_b AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY rank) AS cn FROM {name}_a WHERE hn = 1),
{name} AS (SELECT * FROM {name}_b WHERE cn = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
