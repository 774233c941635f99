"""Order-preserving removal of near-duplicate results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compress(results: DataFrame, group: str = "query_id", rank: str = "rank", flag: str | None = None) -> DataFrame:
    """Drop a result whose non-empty content hash, or whose content, was
    already kept at a better rank of the same question.

    The two tests are applied one after the other: a row dropped for its hash
    must not make later rows with its content disappear. ``flag`` names a
    boolean column that switches the removal on per question.
    """
    digest = F.coalesce(F.col("content_hash"), F.lit(""))
    by_hash = Window.partitionBy(group, digest).orderBy(rank)
    by_text = Window.partitionBy(group, F.sha2("content", 256), "content").orderBy(rank)
    wanted = F.lit(True) if flag is None else F.col(flag)
    first_of_hash = results.withColumn("_nth", F.row_number().over(by_hash)).where(
        ~wanted | (digest == "") | (F.col("_nth") == 1)
    )
    return (
        first_of_hash.withColumn("_nth", F.row_number().over(by_text)).where(~wanted | (F.col("_nth") == 1)).drop("_nth")
    )
