"""Running query metrics and progress as streaming aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from satchel.operators.reports import COMPOSITION


def running_metrics(log: DataFrame, group: Sequence[str] = ("project_id",), tie: str = "event_id") -> DataFrame:
    """Count, mean latency and last composition per group; partial sums are
    formed before the shuffle, the state is one row per group."""
    return log.groupBy(*group).agg(
        F.count("*").alias("query_count"),
        F.avg("latency_ms").alias("avg_ms"),
        F.max_by(F.struct(*COMPOSITION), F.struct("ts", tie)).alias("last_query"),
    )


def latest_table(aggregated: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the current result of a streaming aggregate as a Parquet table,
    one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (
        aggregated.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def percent_throttle(progress: DataFrame, run: Sequence[str] = ("project_id", "migration_id")) -> DataFrame:
    """First event of each whole percent of each migration run. Each run has
    its own percents, so a project can be migrated again. The state is at most
    101 keys per run, spread over all of them."""
    return progress.dropDuplicates([*[c for c in run if c in progress.columns], "percent"])
