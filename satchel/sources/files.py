"""Source files of a directory tree as rows.

Spark's own file listing leaves out dot files, underscore files and empty
files, all of which count here, so the tree is listed by a small data source:
the driver opens directories only until there are enough subtrees to share
out, and tasks walk those. Contents are read in a second, evenly spread step.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from satchel.functions.paths import (
    MAX_FILE_BYTES, SKIPPED_DIRS, base_name, has_usable_size, is_indexable, outside_skipped_dirs, slashed,
)

LISTING_SCHEMA = "path string, rel_path string, length long"
FILE_SCHEMA = "path string, rel_path string, length long, text string"


class _Subtree(InputPartition):
    """Directories to walk, or only their direct files."""

    def __init__(self, paths: list[str], deep: bool):
        self.paths = paths
        self.deep = deep


class TreeSource(DataSource):
    """``format("tree")``: one row per file below ``path``. Directories with a
    skipped name are not entered; unreadable entries are passed over."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], int(self.options.get("subtrees", "256")))


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, subtrees: int):
        self.root = os.path.abspath(root)
        self.subtrees = subtrees

    def partitions(self) -> list[InputPartition]:
        opened: list[_Subtree] = []
        frontier = [self.root]
        # Each directory opened here gives its files as one share and its
        # children as further candidates; the count of opened ones is bounded.
        while frontier and len(frontier) + len(opened) < self.subtrees and len(opened) < self.subtrees:
            here = frontier.pop(0)
            opened.append(_Subtree([here], deep=False))
            frontier.extend(path for path, is_dir in _entries(here) if is_dir)
        # The last directory opened may have any number of children: they are
        # dealt into a bounded number of shares.
        shares = min(len(frontier), self.subtrees)
        return opened + [_Subtree(frontier[n::shares], deep=True) for n in range(shares)]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        todo = list(partition.paths)
        while todo:
            here = todo.pop()
            for path, is_dir in _entries(here):
                if is_dir:
                    if partition.deep:
                        todo.append(path)
                    continue
                try:
                    size = os.stat(path).st_size
                except OSError:
                    size = None
                yield (path, os.path.relpath(path, self.root).replace(os.sep, "/"), size)


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    try:
        with os.scandir(folder) as found:
            for entry in found:
                is_dir = entry.is_dir(follow_symlinks=False)
                if is_dir and entry.name in SKIPPED_DIRS:
                    continue
                yield entry.path, is_dir
    except OSError:
        return


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Indexable files below ``root``: path, rel_path, length."""
    spark.dataSource.register(TreeSource)
    listing = spark.read.format("tree").option("path", root).load()
    return listing.where(is_indexable(base_name(F.col("rel_path"))) & outside_skipped_dirs(F.col("rel_path")))


def read_files(spark: SparkSession, root: str, project_id: str, source_dir: str | None = None) -> DataFrame:
    """Files of a tree with their text, as FILE rows.

    Empty, oversized and unreadable files keep a row without text: they still
    count as present. ``source_dir`` defaults to the base name of the root.
    """
    listing = list_tree(spark, root)
    # Listing one directory is sequential; reading its files need not be.
    spread = listing.repartition(F.xxhash64("rel_path"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                rows = batch.slice(start, 64)
                texts = [_text_of(p, n) for p, n in zip(rows.column("path").to_pylist(), rows.column("length").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, "text"]
                )

    tag = source_dir or os.path.basename(os.path.abspath(root))
    return spread.mapInArrow(read, FILE_SCHEMA).select(
        F.lit(project_id).alias("project_id"), F.lit(tag).alias("source_dir"), "rel_path", "length", "text"
    )


def _text_of(path: str, length: int | None) -> str | None:
    if length is None or not 1 <= length <= MAX_FILE_BYTES:
        return None
    try:
        with open(path, "rb") as handle:
            return handle.read().decode("utf-8", errors="replace")
    except OSError:
        return None


def files_from_table(
    table: DataFrame, project_id, source_dir, rel_path, text
) -> DataFrame:
    """FILE rows from a table that already holds paths and texts."""
    return table.select(
        project_id.alias("project_id"),
        source_dir.alias("source_dir"),
        slashed(rel_path).alias("rel_path"),
        F.octet_length(text).cast("long").alias("length"),
        text.alias("text"),
    )


def current_files(files: DataFrame) -> DataFrame:
    """Files that count as present, whatever their size."""
    return files.where(is_indexable(base_name(F.col("rel_path"))) & outside_skipped_dirs(F.col("rel_path")))


def readable_files(files: DataFrame) -> DataFrame:
    """Present files whose text is taken in."""
    return current_files(files).where(has_usable_size(F.col("length")) & F.col("text").isNotNull())
