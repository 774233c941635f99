"""Row numbers, best-n per group, global positions and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.session import staged

# Deepest row a page may reach through a plain ordered limit; further pages
# are cut by position.
ORDERED_LIMIT_ROWS = 100_000


def best_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int | str,
    rank: str = "rank",
    spread: int = 1,
    max_n: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1.

    ``n`` may name a column holding the bound of each group; ``max_n`` is then
    its known maximum and lets Spark drop rows before the shuffle. With
    ``spread`` above 1 a group is first cut down in that many slices, so a hot
    group is never sorted whole by one task.
    """
    bound = F.lit(n) if isinstance(n, int) else F.col(n)
    cap = n if isinstance(n, int) else max_n
    if spread > 1 and cap is not None:
        # Equal rows may go to the same slice; the slice only has to be
        # reproducible when a task is run again.
        slice_key = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if _hashable(df, c)]), F.lit(spread))
        df = df.withColumn("_slice", slice_key)
        inner = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= cap).drop("_slice", "_rank")
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    if cap is not None:
        ranked = ranked.where(F.col(rank) <= cap)
    return ranked if isinstance(n, int) else ranked.where(F.col(rank) <= bound)


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def dense_order(score: str = "score", id_: str = "id") -> list[Column]:
    """Best score first; equal scores in id order."""
    return [F.col(score).desc(), F.col(id_).asc()]


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Number all rows from 0 in the given total order, without one task
    seeing them all.

    A global sort leaves contiguous ranges per partition; the sorted rows are
    checkpointed so that partition numbers stay put, then each partition is
    shifted by the sizes of those before it (one row per partition).
    """
    spark = df.sparkSession
    from satchel.session import scratch_root

    scratch_root(spark)
    tag = F.monotonically_increasing_id()
    ordered = df.orderBy(*order).withColumn("_tag", tag).checkpoint()
    part = F.shiftright(F.col("_tag"), 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_tag").bitwiseAND((1 << 33) - 1))
        .drop("_tag", "_part", "_offset")
    )


def page(df: DataFrame, order: Sequence[Column], offset: int | None = 0, limit: int | None = 0) -> DataFrame:
    """One page of an ordered listing. A limit of 0 means all remaining rows;
    negative values count as unset."""
    offset = offset if offset and offset > 0 else 0
    limit = limit if limit and limit > 0 else 0
    if limit and offset + limit <= ORDERED_LIMIT_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    if not limit and not offset:
        return df.orderBy(*order)
    placed = with_position(df, order, "_position")
    wanted = F.col("_position") >= offset
    if limit:
        wanted = wanted & (F.col("_position") < offset + limit)
    return placed.where(wanted).orderBy("_position").drop("_position")


def page_after(df: DataFrame, key: str, last: str | None, limit: int = 256) -> DataFrame:
    """Keyset page: rows after ``last`` in key order, resumable by the last
    key of the page."""
    if last is not None:
        df = df.where(F.col(key) > last)
    return df.orderBy(key).limit(limit)


def latest(df: DataFrame, n: int, group: Sequence[str] = (), ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The most recent ``n`` rows overall or per group."""
    order = [F.col(ts).desc(), F.col(tie).desc()]
    if not group:
        return df.orderBy(*order).limit(n)
    return best_per_group(df, group, order, n, rank="recency", spread=16)


def batches_of(df: DataFrame, order: Sequence[Column], size: int, name: str = "batch") -> DataFrame:
    """Consecutive batch numbers from 0 in the given order."""
    placed = with_position(df, order, "_position")
    return placed.withColumn(name, F.floor(F.col("_position") / size).cast("long")).drop("_position")


__all__ = [
    "best_per_group", "dense_order", "with_position", "page", "page_after", "latest", "batches_of", "staged",
]
