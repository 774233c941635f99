"""Upsert and delete on keyed rows as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("project_id", "id")


def last_wins(rows: DataFrame, key: Sequence[str] = KEY, ordinal: str = "ordinal") -> DataFrame:
    """One row per key, the one with the highest ordinal. An aggregate, so
    copies of one key collapse before the shuffle."""
    rest = [c for c in rows.columns if c not in (*key, ordinal)]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_row"))
    return picked.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """New rows replace the whole of existing rows with their key."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def insert_only(existing: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows with a known key are left as they are."""
    return existing.unionByName(new.join(existing.select(*key), list(key), "left_anti"))


def delete(existing: DataFrame, keys: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Without the listed keys; other projects are untouched."""
    return existing.join(keys.select(*key), list(key), "left_anti")


def delete_project(existing: DataFrame, project_id: str) -> DataFrame:
    return existing.where(F.col("project_id") != project_id)


def with_known_projects(queries: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions whose project exists, and those whose project does not."""
    known = projects.select("project_id").distinct()
    return queries.join(known, "project_id", "left_semi"), queries.join(known, "project_id", "left_anti")
