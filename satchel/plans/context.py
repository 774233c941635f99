"""Search results as one context string per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.meta import score_band, shown_file, shown_type
from satchel.functions.text import highlight, preview, three_decimals


def context_line() -> F.Column:
    return F.concat(F.lit("[score "), three_decimals(F.col("score")), F.lit("] "), F.col("content"))


def assemble(results: DataFrame) -> DataFrame:
    """query_id, context: scored texts in rank order, a blank line between.
    A question has at most k results, so its string is bounded."""
    parts = results.select("query_id", F.struct("rank", context_line().alias("line")).alias("part"))
    ordered = F.transform(F.sort_array(F.collect_list("part")), lambda p: p["line"])
    return parts.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"), F.count("*").alias("n_results"))


def contexts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """As above for every question asked; no result gives an empty string."""
    return queries.select("query_id").join(assemble(results), "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_results", F.lit(0)).alias("n_results")
    )


def presented(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results as shown: band, marked snippet, file and type placeholders."""
    return results.join(queries.select("query_id", "query"), "query_id").select(
        "query_id",
        "rank",
        "score",
        score_band(F.col("score")).alias("band"),
        highlight(preview(F.col("content")), F.col("query")).alias("snippet"),
        shown_file(F.col("source_file"), "unknown").alias("file"),
        shown_type(F.col("meta")["type"]).alias("type"),
    )
