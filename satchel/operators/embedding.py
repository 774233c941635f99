"""Embedding stage: a user function over bounded batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.functions.text import tokens

# texts -> vectors, or (vectors, tokens used)
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

DEFAULT_BATCH = 128
TEXTS_AT_ONCE = 512  # texts whose words are counted together
WORDS_AT_ONCE = 16_384  # distinct words that are hashed together


def embed(
    df: DataFrame,
    fn: Embedder,
    text: str = "content",
    batch_size: int = DEFAULT_BATCH,
    into: str = "embedding",
    used: str = "tokens",
    counts_tokens: bool = False,
) -> DataFrame:
    """Add one vector per text, calling ``fn`` with at most ``batch_size`` texts.

    Only the text column crosses to Python. A count of vectors that differs
    from the count of texts is an error. The function must give the same
    answer when a lost task is run again.
    """
    step = batch_size if batch_size > 0 else DEFAULT_BATCH

    @F.pandas_udf("struct<vector: array<float>, used: bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            vectors, usage = [], []
            for start in range(0, len(texts), step):
                batch = texts.iloc[start : start + step].tolist()
                made = fn(batch)
                made, spent = made if counts_tokens else (made, 0)
                if len(made) != len(batch):
                    raise ValueError(f"embedder gave {len(made)} vectors for {len(batch)} texts")
                vectors.extend(np.asarray(v, dtype=np.float32) for v in made)
                # The batch's usage is booked on its first row.
                usage.extend([int(spent)] + [0] * (len(batch) - 1))
            yield pd.DataFrame({"vector": vectors, "used": usage})

    staged_column = "_embedded"
    return (
        df.withColumn(staged_column, run.asNondeterministic()(F.col(text)))
        .withColumn(into, F.col(f"{staged_column}.vector"))
        .withColumn(used, F.col(f"{staged_column}.used"))
        .drop(staged_column)
    )


def by_returned_index(vectors: DataFrame, key: str = "batch_id", idx: str = "idx") -> DataFrame:
    """Vectors of a response in input order, whatever order they came in."""
    return vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(idx, "embedding"))).alias("ordered"))


def word_bucket(word: str, dim: int) -> int:
    """Bucket of a word: leading 32 bits of its MD5, modulo ``dim``."""
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic vector of a text: word counts per bucket, unit length.

    Words are cut in the JVM; each distinct word of an Arrow batch is hashed
    once and counts are one ``bincount`` for many texts. A text without words
    gets the zero vector.
    """

    def hashed(words: pa.Array) -> np.ndarray:
        # Some words at a time, as Python strings take several times their room.
        buckets = np.empty(len(words), dtype=np.int32)
        for start in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(start, WORDS_AT_ONCE).to_pylist()
            buckets[start : start + len(some)] = [word_bucket(w, dim) for w in some]
        return buckets

    def unit_vectors(buckets: np.ndarray, lengths: np.ndarray) -> pa.Array:
        rows = len(lengths)
        cell = np.repeat(np.arange(rows, dtype=np.int32) * dim, lengths) + buckets
        counts = np.bincount(cell, minlength=rows * dim).reshape(rows, dim).astype(np.float64)
        size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, size, out=np.zeros_like(counts), where=size > 0).astype(np.float32)
        offsets = np.arange(0, rows * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.reshape(-1), pa.float32()))

    @F.arrow_udf("array<float>")
    def count_up(words: pa.Array) -> pa.Array:
        encoded = words.flatten().dictionary_encode()
        buckets = hashed(encoded.dictionary)
        lengths = np.diff(words.offsets.to_numpy())
        ends = np.cumsum(lengths)
        # A bounded number of texts at a time: the arrays of a whole batch take
        # several times the room of its words.
        parts = []
        for start in range(0, len(words), TEXTS_AT_ONCE):
            many = lengths[start : start + TEXTS_AT_ONCE]
            first, last = int(ends[start] - lengths[start]), int(ends[start + len(many) - 1])
            parts.append(unit_vectors(buckets[encoded.indices.slice(first, last - first).to_numpy()], many))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return count_up(F.coalesce(tokens(text), F.array().cast("array<string>")))


def hash_embed(df: DataFrame, text: str = "content", dim: int = 64, into: str = "embedding") -> DataFrame:
    """The built-in embedder as a stage; its token usage is the word count."""
    return df.withColumn(into, hash_embedding(F.col(text), dim)).withColumn("tokens", F.size(tokens(F.col(text))).cast("long"))
