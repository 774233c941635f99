"""The usage log: tokens that stages have spent, written as they are spent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from satchel.schema import USAGE


def record_usage(spark: SparkSession, path: str, stage: str, tokens: int, model: str | None = None) -> None:
    """Append one row to the usage log."""
    row = spark.range(1).select(
        F.current_timestamp().alias("ts"), F.lit(stage).alias("stage"), F.lit(model).cast("string").alias("model"), F.lit(int(tokens)).cast("long").alias("tokens")
    )
    row.select(*USAGE.fieldNames()).write.mode("append").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE).parquet(path)


class Metered:
    """A stage that counts the ``tokens`` its rows carry while the job that
    consumes them runs. A task that is run again replaces what its lost try
    has counted. Without a log, or without the column, nothing is added."""

    def __init__(self, stage: Callable[[DataFrame], DataFrame], name: str, model: str | None = None, log: str | None = None):
        self.stage, self.name, self.model, self.log = stage, name, model, log
        self.seen: Observation | None = None

    def __call__(self, rows: DataFrame) -> DataFrame:
        made = self.stage(rows)
        if self.log is None or "tokens" not in made.columns:
            return made
        self.seen = Observation()
        return made.observe(self.seen, F.sum("tokens").alias("tokens"))

    def record(self, spark: SparkSession) -> int:
        """Write down what was spent, once the rows are consumed."""
        if self.seen is None or self.log is None:
            return 0
        spent = self.seen.get.get("tokens") or 0
        record_usage(spark, self.log, self.name, spent, self.model)
        return spent
