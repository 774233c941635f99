"""Connected components as joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.session import staged


def _sum(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (u, v): the smallest vertex
    it is connected with. Each step links the neighbours of a vertex to its
    smallest one; a vertex with very many neighbours is only a skewed join
    key, its minimum is found by partial aggregates."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    before = _sum(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours, and the vertex itself, do too.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.*").where("u <> v").distinct(), "edges")
        now = _sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("u"), "v")
    return edges.union(roots).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component"))
