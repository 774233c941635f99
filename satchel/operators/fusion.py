"""Reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.operators.ranking import best_per_group, dense_order

# Fixed value: rank offset of the fusion formula.
RRF_OFFSET = 60


def rrf_share(rank: Column) -> Column:
    """A list's contribution: 1/(60+rank), or 0 where the row is absent."""
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_OFFSET) + rank), F.lit(0.0))


def full_outer(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both lists side by side on (query_id, project_id, id) with origin flags."""
    left = dense.select("query_id", "project_id", "id", F.col("rank").alias("dense_rank"))
    right = lexical.select("query_id", "project_id", "id", F.col("rank").alias("lexical_rank"))
    return (
        left.join(right, ["query_id", "project_id", "id"], "full_outer")
        .withColumn("in_dense", F.col("dense_rank").isNotNull())
        .withColumn("in_lexical", F.col("lexical_rank").isNotNull())
    )


def fuse(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Fused score of every row found by either list.

    Both lists are already cut to the recall of their question, so the join
    moves at most two recalls per question.
    """
    return full_outer(dense, lexical).withColumn(
        "score", rrf_share(F.col("dense_rank")) + rrf_share(F.col("lexical_rank"))
    )


def best_fused(fused: DataFrame, bounds: DataFrame, k: str = "recall") -> DataFrame:
    """Fused rows in score order, cut to each question's bound."""
    sized = fused.join(bounds.select("query_id", F.col(k).alias("_k")), "query_id")
    return best_per_group(sized, ["query_id"], dense_order(), "_k").drop("_k", "dense_rank", "lexical_rank")
