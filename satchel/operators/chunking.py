"""Files to chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.hashing import content_hash
from satchel.functions.meta import chunk_id, stored_content
from satchel.functions.text import chunk_text
from satchel.sources.files import readable_files

DEFAULT_CHUNK_CHARS = 1_500


def chunk_files(files: DataFrame, max_chars: int = DEFAULT_CHUNK_CHARS) -> DataFrame:
    """One row per chunk of every readable file: project_id, source_dir,
    source_file, position, id, chunk, content_hash, content.

    The hash is taken over the chunk itself, before the file line is put in
    front of it.
    """
    size = max_chars if max_chars and max_chars > 0 else DEFAULT_CHUNK_CHARS
    pieces = readable_files(files).select(
        "project_id",
        "source_dir",
        F.col("rel_path").alias("source_file"),
        F.posexplode(chunk_text(F.col("text"), size)).alias("position", "chunk"),
    )
    return pieces.select(
        "*",
        chunk_id(F.col("source_dir"), F.col("source_file"), F.col("position")).alias("id"),
        content_hash(F.col("chunk")).alias("content_hash"),
        stored_content(F.col("source_file"), F.col("chunk")).alias("content"),
    )
