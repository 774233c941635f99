"""Counts, shares and query metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.meta import shown_file
from satchel.operators.percentile import percentiles
from satchel.operators.ranking import best_per_group, latest

# Most recent latencies kept, files shown, events kept and shown.
LATENCY_SAMPLES = 512
FILES_SHOWN = 8
EVENTS_KEPT = 50
EVENTS_SHOWN = 8

P50_P95 = (("p50_ms", 0.50), ("p95_ms", 0.95))
COMPOSITION = ("hybrid", "reranked", "candidates", "results", "dense_count", "lexical_count", "rerank_moved")


def chunk_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("project_id").agg(F.count("*").alias("chunk_count"))


def counts_of(projects: DataFrame, points: DataFrame) -> DataFrame:
    """Chunk count of every listed project, 0 where it has no points."""
    return projects.select("project_id").distinct().join(chunk_counts(points), "project_id", "left").select(
        "project_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )


def project_ids(points: DataFrame) -> DataFrame:
    return points.select("project_id").distinct().orderBy("project_id")


def global_stats(points: DataFrame) -> DataFrame:
    """Totals from per-project partial counts, so no distinct set is built."""
    per_project = points.groupBy("project_id").agg(
        F.count("*").alias("chunks"), F.max("embed_model").alias("embed_model")
    )
    return per_project.agg(
        F.count("*").alias("total_projects"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"),
        F.max("embed_model").alias("embed_model"),
    )


def file_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("project_id", shown_file(F.col("source_file")).alias("file")).agg(
        F.count("*").alias("chunk_count")
    )


def top_files(points: DataFrame, n: int = FILES_SHOWN) -> DataFrame:
    """The files with most chunks of each project, and each one's share of
    the largest."""
    top = best_per_group(
        file_counts(points), ["project_id"], [F.col("chunk_count").desc(), F.col("file").asc()], n, spread=16
    )
    largest = top.where(F.col("rank") == 1).select("project_id", F.col("chunk_count").alias("largest"))
    return top.join(largest, "project_id").select(
        "project_id", "file", "chunk_count", "rank", (F.col("chunk_count") / F.col("largest")).alias("share")
    )


def distinct_files(points: DataFrame) -> DataFrame:
    return file_counts(points).groupBy("project_id").agg(F.count("*").alias("files"))


def origin_share(composition: DataFrame) -> DataFrame:
    """Dense and lexical parts of a composition; none when both are zero."""
    total = F.col("dense_count") + F.col("lexical_count")
    return composition.where(total > 0).withColumn("dense_share", F.col("dense_count") / total).withColumn(
        "lexical_share", F.col("lexical_count") / total
    )


def latency_summary(log: DataFrame) -> DataFrame:
    """Query count, mean and percentiles over the whole log; zeros if empty."""
    found = percentiles(log, "latency_ms", P50_P95)
    return found.select(
        F.col("n").alias("query_count"), F.col("mean").alias("avg_ms"), "p50_ms", "p95_ms"
    )


def recent_latency_summary(log: DataFrame, samples: int = LATENCY_SAMPLES, tie: str = "event_id") -> DataFrame:
    """As above with mean and percentiles over the most recent queries only.
    The count stays that of the whole log."""
    recent = latest(log.select("ts", tie, "latency_ms"), samples, tie=tie)
    summary = latency_summary(recent).drop("query_count")
    total = log.agg(F.count("*")).scalar()
    return summary.select(total.alias("query_count"), "avg_ms", "p50_ms", "p95_ms")


def last_query(log: DataFrame, group: list[str] | None = None, tie: str = "event_id") -> DataFrame:
    """Composition of the most recent query; no row before the first."""
    newest = F.max_by(F.struct(*COMPOSITION), F.struct("ts", tie)).alias("c")
    picked = log.groupBy(*(group or [])).agg(newest, F.count("*").alias("_n")).where(F.col("_n") > 0)
    return picked.select(*(group or []), "c.*")


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens per stage from a usage log of (stage, tokens)."""

    def of(stage: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("tokens"))), F.lit(0)).alias(f"tokens_{stage}")

    return usage.agg(of("embed"), of("rerank")).withColumn(
        "tokens_total", F.col("tokens_embed") + F.col("tokens_rerank")
    )


def metrics_snapshot(log: DataFrame, usage: DataFrame, backend: str = "parquet", tie: str = "event_id") -> DataFrame:
    """One row: latency summary of the durable log, tokens, last composition."""
    newest = log.agg(F.max_by(F.struct(*COMPOSITION), F.struct("ts", tie))).scalar()
    used = token_usage(usage).select(F.struct("tokens_embed", "tokens_rerank", "tokens_total")).scalar()
    return (
        latency_summary(log)
        .select("*", used.alias("_used"), newest.alias("last_query"))
        .select("query_count", "avg_ms", "p50_ms", "p95_ms", "_used.*", "last_query")
        .withColumn("persistent", F.lit(True))
        .withColumn("backend", F.lit(backend))
    )


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent; 0 when there is nothing to do."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("int")


def batch_progress(totals: DataFrame, batch: int = 64) -> DataFrame:
    """Progress after every batch: project_id, seq, done, total, percent, and
    migration_id if the totals have one.

    ``totals`` has project_id and total. Batches follow from the totals alone,
    so no row is numbered. Blocks of a thousand batches are spread first.
    """
    size = batch if batch > 0 else 64
    last = F.ceil(F.col("total") / size).cast("long")
    run = ["project_id", *[c for c in ("migration_id",) if c in totals.columns]]
    blocks = totals.select(
        *run, "total", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(1000).cast("long"))).alias("_first")
    ).repartition(*run, "_first")
    steps = blocks.select(
        *run,
        "total",
        F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + 999, F.col("_last")))).alias("seq"),
    )
    done = F.least(F.col("seq") * size, F.col("total"))
    return steps.select(
        *run, "seq", done.alias("done"), "total", percent_done(done, F.col("total")).alias("percent")
    )


def percent_changes(progress: DataFrame) -> DataFrame:
    """The rows at which the whole percent changes. Progress never goes back,
    so these are the first rows of each percent: an aggregate, not a sort."""
    run = ["project_id", *[c for c in ("migration_id",) if c in progress.columns]]
    first = progress.groupBy(*run, "percent").agg(F.min_by(F.struct("seq", "done", "total"), "seq").alias("f"))
    return first.select(*run, "f.seq", "f.done", "f.total", "percent")


def activity(events: DataFrame, n: int = EVENTS_KEPT, tie: str = "event_id") -> DataFrame:
    """The most recent events, newest first, with a short description."""
    d = F.col("data")
    text = F.coalesce(
        F.when(
            d["indexed"].isNotNull(),
            F.concat(d["indexed"], F.lit(" chunks, "), F.coalesce(d["deleted"], F.lit("0")), F.lit(" deleted")),
        ),
        F.when(d["candidates"].isNotNull(), F.concat(d["candidates"], F.lit(" candidates"))),
        d["directory"],
        F.when(d["count"].isNotNull(), F.concat(d["count"], F.lit(" points"))),
        F.col("project_id"),
    )
    return latest(events, n, tie=tie).withColumn("description", text).withColumn(
        "is_ok", F.col("type").isin("index_completed", "query_executed")
    )
