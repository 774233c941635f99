"""Metadata maps: building, merging, filtering, JSON parsing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from satchel.schema import COLUMN_KEYS


def chunk_id(source_dir: Column, rel_path: Column, position: Column) -> Column:
    return F.concat(source_dir, F.lit("/"), rel_path, F.lit("#chunk"), position.cast("string"))


def stored_content(rel_path: Column, chunk: Column) -> Column:
    return F.concat(F.lit("File: "), rel_path, F.lit("\n\n"), chunk)


def chunk_meta(rel_path: Column, source_dir: Column, position: Column, digest: Column) -> Column:
    return F.create_map(
        F.lit("source_file"), rel_path,
        F.lit("source_dir"), source_dir,
        F.lit("chunk_index"), position.cast("string"),
        F.lit("content_hash"), digest,
        F.lit("chunk_version"), F.lit("v2"),
    )


def merge_caller_wins(defaults: Column, meta: Column) -> Column:
    """Union of two maps in which the caller's entry replaces a default."""
    own = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)


def provenance(model: str | None, dim: Column) -> Column:
    return F.create_map(
        F.lit("embed_model"), F.lit(model or "unknown"),
        F.lit("embed_dim"), dim.cast("string"),
    )


def meta_matches(wanted: Mapping[str, str], meta: str = "meta") -> Column:
    """Every wanted key holds the wanted value. Keys kept as columns are
    compared there, so the predicate reaches the scan."""
    tests = [
        (F.col(key) if key in (*COLUMN_KEYS, "embed_model") else F.col(meta)[key]) == F.lit(value)
        for key, value in wanted.items()
    ]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def own_identity(doc_id: Column, id_: Column) -> Column:
    """The caller's document id where one was kept, else the stored id."""
    return F.coalesce(F.nullif(doc_id, F.lit("")), id_)


def string_entries(variants: Column) -> Column:
    """Keep the string-valued entries of a map<string,variant>."""
    texts = F.map_filter(variants, lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.transform_values(texts, lambda k, v: F.try_variant_get(v, "$", "string"))


def string_entries_of_json(payload: Column) -> Column:
    return string_entries(F.from_json(payload, "map<string,variant>"))


def shown_file(source_file: Column, placeholder: str = "(unknown)") -> Column:
    return F.coalesce(F.nullif(source_file, F.lit("")), F.lit(placeholder))


def shown_type(kind: Column) -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("snippet"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.75, "good").when(score >= 0.5, "warn").otherwise("faint")


def or_default(value: Column, default: int) -> Column:
    """Option defaulting: unset, zero and negative mean the default."""
    return F.when(value > 0, value).otherwise(F.lit(default))
