"""Documents to stored points, points to listings and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.meta import merge_caller_wins, meta_matches, own_identity, provenance
from satchel.functions.text import preview
from satchel.schema import COLUMN_KEYS, POINT


def to_points(embedded: DataFrame, model: str | None = None) -> DataFrame:
    """POINT rows from project_id, id, content, meta, embedding.

    Provenance is added under the caller's metadata; keys with a column of
    their own move there.
    """
    own = F.col("meta")
    merged = merge_caller_wins(provenance(model, F.size("embedding")), own)
    # Columns are taken from the caller's map, so that a scan for them does not
    # depend on the vector.
    return embedded.select(
        "project_id",
        "id",
        "content",
        *[own[key].alias(key) for key in COLUMN_KEYS],
        F.map_filter(merged, lambda k, v: ~k.isin(*COLUMN_KEYS)).alias("meta"),
        F.coalesce(own["embed_model"], F.lit(model or "unknown")).alias("embed_model"),
        F.size("embedding").alias("embed_dim"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    ).select(*POINT.fieldNames())


def full_meta() -> Column:
    """The metadata map with the column keys put back; absent keys stay out."""
    held = F.map_from_entries(
        F.array_compact(
            F.array(
                *[F.when(F.col(key).isNotNull(), F.struct(F.lit(key).alias("key"), F.col(key).alias("value"))) for key in COLUMN_KEYS]
            )
        )
    )
    return merge_caller_wins(held, F.col("meta"))


def list_points(points: DataFrame, where: Mapping[str, str] | None = None) -> DataFrame:
    """Listing rows with a preview; vectors and full texts are not read."""
    chosen = points.where(meta_matches(where)) if where else points
    shown = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source_file", "content_hash", "chunk_version", "doc_id")]
    return chosen.select(
        "project_id", "id", *shown, preview(F.col("content")).alias("content"),
        F.coalesce("chunk_index", F.lit("")).alias("chunk_index"),
    )


def listing_order(numeric: bool = False) -> list[Column]:
    """File, then chunk index in text order ("10" before "2") or by number."""
    index = F.col("chunk_index").try_cast("decimal(38,0)").asc() if numeric else F.col("chunk_index").asc()
    return [F.col("source_file").asc(), index, F.col("id").asc()]


def export_documents(points: DataFrame) -> DataFrame:
    """Every point with its whole text and metadata, under its own identity."""
    return points.select(
        "project_id", own_identity(F.col("doc_id"), F.col("id")).alias("id"), "content", full_meta().alias("meta")
    )


def dimensions(points: DataFrame) -> DataFrame:
    """Vector sizes in use per project; more than one means a broken index."""
    return points.groupBy("project_id").agg(
        F.min("embed_dim").alias("min_dim"), F.max("embed_dim").alias("max_dim"), F.count("*").alias("points")
    )
