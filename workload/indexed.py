"""Queries through the indexes of a store: N01, N02, J11, F07, X03."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.bm25 import bm25
from satchel.operators.dense import dense_topk
from satchel.operators.keyed import KEY
from satchel.session import staged
from satchel.sources.indexes import CellIndex, WordIndex
from satchel.sources.store import PointStore
from workload.base import MATCHES_SQL, POINTS_SQL, QUESTIONS_SQL, Tables, query, trial_store, with_
from workload.searches import SEARCHED_SQL, searched_by

CELLS = 16
# The third chunk of a file, and every third after it, is deleted in the end.
KEPT_SQL = POINTS_SQL + ",\nkept AS (SELECT * FROM points WHERE position % 3 <> 2)"


def changed_store(t: Tables) -> PointStore:
    """A store whose word index has lived through an insert of other texts, the
    upsert that replaces them and a deletion."""
    store = trial_store(t)
    keys, first = t.indexed.select(*KEY), F.col("chunk_index") < "5"
    stale = t.indexed.where(first).withColumn("content", F.concat(F.upper("content"), F.lit(" stale word stale")))
    store.upsert(stale, keys=t.indexed.where(first).select(*KEY))
    WordIndex.create(store, 4)
    store.upsert(t.indexed, keys=keys)
    store.delete_points(t.indexed.where("chunk_index % 3 = 2"))
    return store


@query(
    "n02_word_statistics",
    with_(KEPT_SQL)
    + """SELECT substr(sha256(project_id), 1, 16) AS project_key, term, count(DISTINCT id) AS df, count(*) AS tf
         FROM (SELECT project_id, id, unnest(words) AS term FROM kept) GROUP BY ALL""",
)
def word_statistics(t: Tables) -> DataFrame:
    """Kept up by commits, not counted again."""
    return WordIndex(changed_store(t)).statistics()[0]


@query(
    "n02_project_sizes",
    with_(KEPT_SQL)
    + "SELECT substr(sha256(project_id), 1, 16) AS project_key, count(*) AS n_docs, round(avg(len(words)), 6) AS mean_length FROM kept GROUP BY ALL",
)
def project_sizes(t: Tables) -> DataFrame:
    return WordIndex(changed_store(t)).statistics()[1].withColumn("mean_length", F.round("mean_length", 6))


@query(
    "j11_lexical_match_word_index",
    with_(POINTS_SQL, QUESTIONS_SQL, MATCHES_SQL) + "SELECT query_id, id, lex_score FROM matches",
)
def match_by_index(t: Tables) -> DataFrame:
    store = trial_store(t)
    index = WordIndex.create(store, 4)
    some = t.indexed.where("source_dir < 'f'")
    store.upsert(some, keys=some.select(*KEY))
    store.upsert(t.indexed, keys=t.indexed.select(*KEY))
    return index.matches(t.questions).select("query_id", "id", "lex_score")


BM25_SQL = (
    with_(KEPT_SQL, QUESTIONS_SQL)
    + """, sizes AS (SELECT project_id, count(*) AS n, avg(len(words)) AS mean FROM kept GROUP BY 1),
dfs AS (SELECT project_id, term, count(DISTINCT id) AS df FROM (SELECT project_id, id, unnest(words) AS term FROM kept) GROUP BY ALL),
found AS (
  SELECT q.query_id, p.project_id, p.id, p.words, unnest(q.terms) AS term FROM questions q JOIN kept p ON q.project_id = p.project_id
  WHERE len(q.terms) > 0 AND list_has_all(p.words, q.terms)),
counted AS (SELECT *, len(list_filter(words, lambda w: w = term)) AS tf, len(words) AS length FROM found)
SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS lex_score
FROM counted c JOIN dfs d ON c.project_id = d.project_id AND c.term = d.term JOIN sizes s ON c.project_id = s.project_id GROUP BY query_id, id"""
)


@query("f07_bm25", BM25_SQL)
def bm25_scores(t: Tables) -> DataFrame:
    """After upserts and deletions, with the statistics that commits kept up."""
    found = WordIndex(changed_store(t)).matches(t.questions, bm25())
    return found.select("query_id", "id", F.round("lex_score", 6).alias("lex_score"))


def celled(t: Tables) -> tuple[PointStore, CellIndex]:
    """Centres from a part of the points, the rest assigned by a later commit."""
    store = trial_store(t)
    store.upsert(t.indexed.where("chunk_index < '2'"))
    index = CellIndex.create(store, CELLS)
    store.upsert(t.indexed.where("chunk_index >= '2'"))
    return store, index


@query(
    "n01_index_probes",
    with_(POINTS_SQL, QUESTIONS_SQL) + "SELECT query_id, least(10, n)::BIGINT AS n_found, true AS every_hit_exact, true AS recall_reached FROM questions JOIN (SELECT project_id, count(*) AS n FROM points GROUP BY 1) USING (project_id)",
)
def index_probes(t: Tables) -> DataFrame:
    """As many cells probed as a sample of the questions needs for 95 % of its
    neighbours. Hits must be exact, and nine of ten exact answers among them."""
    store, index = celled(t)
    asked = t.questions.withColumn("recall", F.lit(10))
    found = index.topk(asked, index.probes_for(0.95, asked=asked)).select("query_id", "id", "score")
    exact = dense_topk(store.points(), asked.withColumn("recall", F.lit(1_000_000))).select("query_id", "id", F.col("score").alias("true_score"), F.col("rank").alias("true_rank"))
    both = exact.join(found, ["query_id", "id"], "left")
    near = F.col("true_rank") <= 10
    # All pairs are made once: a row for each question holds what both answers need.
    each = staged(
        both.groupBy("query_id").agg(
            F.count("score").alias("n_found"),
            F.coalesce(F.bool_and(F.when(F.col("score").isNotNull(), F.col("score") == F.col("true_score"))), F.lit(True)).alias("every_hit_exact"),
            F.count_if(near & F.col("score").isNotNull()).alias("near_found"), F.count_if(near).alias("near"),
        ),
        "probed",
    )
    share = each.agg((F.sum("near_found") / F.sum("near") >= 0.9).alias("recall_reached"))
    return each.select("query_id", "n_found", "every_hit_exact", F.lit(share.first()["recall_reached"]).alias("recall_reached"))


@query(
    "x03_search_indexed",
    SEARCHED_SQL + "SELECT query_id, id, rank, round(score, 6) AS score, in_dense, in_lexical, content_hash FROM compressed",
)
def search_indexed(t: Tables) -> DataFrame:
    """The whole search through both indexes, all cells probed."""
    store, cells = celled(t)
    words = WordIndex.create(store, 4)
    answer = searched_by(t, store.points(), buckets=store.buckets, words=words, cells=cells, probes=CELLS)
    return answer.results.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "in_dense", "in_lexical", "content_hash")
