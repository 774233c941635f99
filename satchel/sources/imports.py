"""Exported pages of other stores as documents.

Every reader takes a DataFrame with one JSON page per row (column ``page``)
and returns DOCUMENT rows. Metadata keeps its string values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.meta import own_identity, string_entries

TEXT_FIELD = "content"
_OBJECT = "map<string,variant>"


def _text(entries: Column, field: str) -> Column:
    return F.coalesce(entries[field], F.lit(""))


def id_and_vector_pages(listed: DataFrame, fetched: DataFrame, text_field: str = TEXT_FIELD) -> DataFrame:
    """Two kinds of page: lists of ids, and maps from id to object. Listed ids
    without a fetched object are absent from the result."""
    ids = (
        listed.select(F.from_json("page", "struct<vectors: array<struct<id: string>>>").alias("p"))
        .select(F.explode("p.vectors.id").alias("id"))
        .distinct()
    )
    objects = fetched.select(
        F.from_json("page", f"struct<vectors: map<string, struct<id: string, metadata: {_OBJECT}>>>").alias("p")
    ).select(F.explode("p.vectors").alias("key", "v"))
    meta = string_entries(F.coalesce(F.col("v.metadata"), F.create_map().cast(_OBJECT)))
    return (
        objects.withColumn("meta", meta)
        .select(F.col("key"), F.coalesce("v.id", F.lit("")).alias("id"), "meta")
        .join(ids.withColumnRenamed("id", "key"), "key")
        .select("id", _text(F.col("meta"), text_field).alias("content"), "meta")
    )


def nested_pages(pages: DataFrame, text_field: str = TEXT_FIELD) -> DataFrame:
    """Objects below data.Get.<class>[]; the id sits in ``_additional``."""
    objects = (
        pages.select(F.from_json("page", f"struct<data: map<string, map<string, array<{_OBJECT}>>>>").alias("p"))
        .select(F.explode("p.data.Get").alias("class", "objects"))
        .select(F.explode("objects").alias("o"))
    )
    meta = string_entries(F.col("o"))
    return objects.select(
        F.coalesce(F.try_variant_get(F.col("o")["_additional"], "$.id", "string"), F.lit("")).alias("id"),
        _text(meta, text_field).alias("content"),
        meta.alias("meta"),
    )


def parallel_array_pages(pages: DataFrame, text_field: str = TEXT_FIELD, stored: bool = False) -> DataFrame:
    """ids[][], documents[][], metadatas[][] side by side; short or missing
    arrays give empty text and metadata. Empty text falls back to the text
    field. ``stored`` marks a collection written by this library, whose
    original document id is in the metadata."""
    parsed = pages.select(
        F.from_json(
            "page",
            f"struct<ids: array<array<string>>, documents: array<array<string>>, metadatas: array<array<{_OBJECT}>>>",
        ).alias("p")
    )
    cells = (
        parsed.select("p", F.posexplode("p.ids").alias("b", "ids"))
        .select("p", "b", F.posexplode("ids").alias("i", "id"))
    )
    document = F.get(F.get("p.documents", F.col("b")), F.col("i"))
    raw = F.get(F.get("p.metadatas", F.col("b")), F.col("i"))
    meta = F.coalesce(string_entries(raw), F.create_map().cast("map<string,string>"))
    rows = cells.select("id", document.alias("document"), meta.alias("meta"))
    content = F.coalesce(F.nullif("document", F.lit("")), _text(F.col("meta"), text_field))
    if stored:
        return rows.select(
            own_identity(F.col("meta")["doc_id"], F.col("id")).alias("id"),
            F.coalesce("document", F.lit("")).alias("content"),
            "meta",
        )
    return rows.select("id", content.alias("content"), "meta")


def scroll_pages(pages: DataFrame) -> DataFrame:
    """result.points[] with a payload each; the payload's doc_id, where
    present, is the id."""
    points = pages.select(
        F.from_json("page", f"struct<result: struct<points: array<struct<id: string, payload: {_OBJECT}>>>>").alias("p")
    ).select(F.explode("p.result.points").alias("o"))
    meta = string_entries(F.coalesce(F.col("o.payload"), F.create_map().cast(_OBJECT)))
    rows = points.select(F.col("o.id").alias("id"), meta.alias("meta"))
    return rows.select(
        own_identity(F.col("meta")["doc_id"], F.col("id")).alias("id"),
        _text(F.col("meta"), "content").alias("content"),
        "meta",
    )


def distances(pages: DataFrame) -> DataFrame:
    """Answers of a query page: id, content, meta, score = 1 - distance."""
    parsed = pages.select(
        F.from_json(
            "page",
            "struct<ids: array<array<string>>, distances: array<array<double>>, documents: array<array<string>>, "
            f"metadatas: array<array<{_OBJECT}>>>",
        ).alias("p")
    )
    cells = parsed.select("p", F.posexplode(F.get("p.ids", F.lit(0))).alias("i", "id"))
    first = F.lit(0)
    return cells.select(
        "id",
        F.coalesce(F.get(F.get("p.documents", first), F.col("i")), F.lit("")).alias("content"),
        string_entries(F.get(F.get("p.metadatas", first), F.col("i"))).alias("meta"),
        (F.lit(1.0) - F.get(F.get("p.distances", first), F.col("i"))).alias("score"),
    )


LAYOUTS = ("vectors", "nested", "arrays", "pages")


def import_documents(
    pages: DataFrame, layout: str, text_field: str | None = None, listed: DataFrame | None = None
) -> DataFrame:
    """Read exported pages by layout name; an unknown name is an error."""
    field = text_field or TEXT_FIELD
    if layout == "vectors":
        if listed is None:
            raise ValueError("the vectors layout needs its id pages as well")
        return id_and_vector_pages(listed, pages, field)
    if layout == "nested":
        return nested_pages(pages, field)
    if layout == "arrays":
        return parallel_array_pages(pages, field)
    if layout == "pages":
        return scroll_pages(pages)
    raise ValueError(f"unknown layout {layout!r}; known: {', '.join(LAYOUTS)}")
