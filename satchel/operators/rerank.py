"""Second-stage ordering of candidates by a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.text import query_terms, tokens

HIT_SCHEMA = "query_id string, hit int, idx int, relevance_score double"

# (question, texts in candidate order, wanted) -> [(candidate index, score)]
Scorer = Callable[[str, Sequence[str], int], Sequence[tuple[int, float]]]


def term_overlap(query: Column, content: Column) -> Column:
    """Built-in scorer: share of the question's words found in the text."""
    asked = query_terms(query)
    found = F.size(F.array_intersect(asked, tokens(content)))
    return F.when(F.size(asked) > 0, found / F.size(asked)).otherwise(F.lit(0.0))


def rerank_by(candidates: DataFrame, score: Column) -> DataFrame:
    """Hits from a column expression, best first; ties keep candidate order."""
    window = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), F.col("idx"))
    return (
        candidates.select("query_id", (F.col("rank") - 1).alias("idx"), score.alias("relevance_score"))
        .withColumn("hit", F.row_number().over(window) - 1)
        .select("query_id", "hit", "idx", "relevance_score")
    )


def reorder_by(candidates: DataFrame, score: Column, k: str = "k", flag: str = "rerank") -> DataFrame:
    """Candidates in the order of a column expression, cut to k, in one pass.

    The same as applying the hits of ``rerank_by``; questions without the flag
    keep their retrieval order.
    """
    relevance = F.when(F.col(flag), score)
    window = Window.partitionBy("query_id").orderBy(F.col("_relevance").desc_nulls_last(), F.col("rank"))
    return (
        candidates.withColumn("_relevance", relevance)
        .withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= F.col(k))
        .withColumn("score", F.coalesce("_relevance", "score"))
        .withColumn("reranked", F.col(flag))
        .withColumn("moved", F.col(flag) & (F.col("_place") != F.col("rank")))
        .withColumn("rank", F.col("_place"))
        .drop("_relevance", "_place")
    )


CALL_SCHEMA = "query_id string, hits array<struct<hit:int,idx:int,relevance_score:double>>, tokens long, error string"


def rerank_calls(candidates: DataFrame, scorer: Scorer, k: str = "k", counts_tokens: bool = False) -> DataFrame:
    """One row for each question: the hits of a user function, the tokens it
    has spent (if it returns hits and tokens), and what went wrong, if it did.

    A question has at most ``recall`` candidates, which bounds each group. A
    call that fails gives no hits and an ``error``.
    """

    def score_group(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        query_id, question, wanted = (group.column(c)[0].as_py() for c in ("query_id", "query", "k"))
        error, spent = None, 0
        try:
            hits = scorer(question, group.column("content").to_pylist(), wanted)
            hits, spent = hits if counts_tokens else (hits, 0)
            hits = [{"hit": n, "idx": int(i), "relevance_score": float(s)} for n, (i, s) in enumerate(hits)]
        except Exception as failure:  # whatever the function raises: the question keeps its order
            hits, error = [], f"{type(failure).__name__}: {failure}"
        hit = pa.struct([("hit", pa.int32()), ("idx", pa.int32()), ("relevance_score", pa.float64())])
        return pa.table(
            {
                "query_id": pa.array([query_id], pa.string()), "hits": pa.array([hits], pa.list_(hit)),
                "tokens": pa.array([int(spent)], pa.int64()), "error": pa.array([error], pa.string()),
            }
        )

    slim = candidates.select("query_id", "query", "rank", "content", F.col(k).alias("k"))
    return slim.groupBy("query_id").applyInArrow(score_group, CALL_SCHEMA)


def hits_of(calls: DataFrame) -> DataFrame:
    return calls.select("query_id", F.inline("hits"))


def rerank_with(candidates: DataFrame, scorer: Scorer, k: str = "k") -> DataFrame:
    """Hits from a user function, called once per question. A call that fails
    or returns nothing yields no hits, and the question keeps its order."""
    return hits_of(rerank_calls(candidates, scorer, k))


def apply_hits(candidates: DataFrame, hits: DataFrame, k: str = "k") -> DataFrame:
    """Candidates in the reranker's order with its scores, cut to k.

    Hits that point outside the candidates vanish in the join; questions with
    no hit at all keep their retrieval order. ``reranked`` tells which
    happened and ``moved`` whether a row changed position.
    """
    placed = candidates.withColumn("idx", F.col("rank") - 1)
    window = Window.partitionBy("query_id").orderBy("hit")
    reordered = (
        placed.join(hits, ["query_id", "idx"])
        .withColumn("score", F.col("relevance_score"))
        .withColumn("rank", F.row_number().over(window))
        .withColumn("reranked", F.lit(True))
        .withColumn("moved", F.col("rank") - 1 != F.col("idx"))
    )
    unchanged = (
        placed.join(hits.select("query_id").distinct(), "query_id", "left_anti")
        .withColumn("reranked", F.lit(False))
        .withColumn("moved", F.lit(False))
    )
    columns = candidates.columns + ["reranked", "moved"]
    return reordered.select(*columns).unionByName(unchanged.select(*columns)).where(F.col("rank") <= F.col(k))
