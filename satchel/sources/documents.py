"""Caller-supplied documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.hashing import document_id


def documents(
    table: DataFrame, content: Column, id_: Column | None = None, meta: Column | None = None, id_style: str = "uuid"
) -> DataFrame:
    """DOCUMENT rows from any table; missing ids are derived from the content."""
    given = F.lit(None).cast("string") if id_ is None else id_.cast("string")
    own = F.create_map().cast("map<string,string>") if meta is None else meta
    return table.select(
        document_id(given, content, id_style).alias("id"), content.alias("content"), own.alias("meta")
    )
