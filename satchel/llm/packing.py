"""Conflict-constrained best-fit packing of documents into sequences.

Documents are cut into pieces of at most ``capacity`` words; pieces go into
bins, longest first, each into the bin with the smallest residual that holds
it and where neither its source nor its duplicate cluster is present yet. Bins
are kept in order of their residuals and carry their sources and clusters as
bitmaps; the search goes on from one residual to the next larger one until a
compatible bin is found, or opens a new bin.

Documents are dealt into shards by a hash of id, cluster and size, about
``shard_docs`` in each, and a shard is packed in one task; a shard that rows
equal in all three have made four times as large is cut into parts by the
places of its rows. Whatever the corpus holds, a shard is a bounded, evenly
mixed part of it, so a source with a third of all rows is a third of every
shard.

Defined results: a null or empty text has no words and is packed nowhere
(bin and position null, one row); a full piece is a bin of its own; a null
source or cluster conflicts with nothing; repeated ids are packed like other
rows; ties go by the id as text, then piece. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.words import Words, blocks, text_bytes
from satchel.session import staged

CAPACITY = 2_048
SHARD_DOCS = 8_192


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; pieces come in the order of packing."""
    bit: dict = {}
    free: dict[int, dict[int, list[int]]] = {}  # residual -> bitmap of sources -> bins
    sets: list[int] = []  # bitmap of clusters of each bin
    residuals = 0  # bit r: a bin of residual r is open
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        mine = 0 if source is None else 1 << bit.setdefault(("s", source), len(bit))
        group = 0 if cluster is None else 1 << bit.setdefault(("c", cluster), len(bit))
        rest, residual, found = residuals >> size, size, None
        while rest and found is None:
            step = (rest & -rest).bit_length() - 1  # successor among the open residuals
            residual, rest = residual + step, rest >> (step + 1)
            for held, some in free[residual].items():
                if not held & mine:
                    for at, b in enumerate(some):
                        if not sets[b] & group:
                            found = (residual, held, at, b)
                            break
                if found:
                    break
            else:
                residual += 1
        if found is None:
            left, held, b = capacity, 0, len(sets)
            sets.append(0)
        else:
            left, held, at, b = found
            some = free[left][held]
            some[at] = some[-1]
            some.pop()
            if not some:
                del free[left][held]
                if not free[left]:
                    del free[left]
                    residuals &= ~(1 << left)
        bins.append(b)
        offsets.append(capacity - left)
        sets[b] |= group
        left -= size
        if left:
            free.setdefault(left, {}).setdefault(held | mine, []).append(b)
            residuals |= 1 << left
    return bins, offsets


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, cluster, n_words): cluster is a digest of the words, so
    copies that differ in case of A-Z or white space only are one cluster."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            words = Words(*text_bytes(block.column("_text")))
            hashes, first = words.hashes, words.first
            cluster = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), block.column("source"), pa.array(np.frombuffer(b"".join(cluster), np.int64)), pa.array(words.counts)],
                ["id", "source", "cluster", "n_words"],
            )

    some = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("_text"))
    return some.mapInArrow(measure, f"id {id_type}, source string, cluster long, n_words long")


def pack(items: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(id, piece, first_word, n_words, bin, bin_offset) of every piece of
    ``items`` (id, source, cluster, n_words); bins are named shard-part-number."""
    items = staged(items, "measured")
    shards = items.count() // shard_docs + 1
    id_type = items.schema["id"].dataType.simpleString()

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = np.maximum(1, -(-rows.n_words.to_numpy() // capacity))
        at = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        out = rows.iloc[at][["id", "source", "cluster", "n_words", "shard", "part"]].reset_index(drop=True)
        out["piece"], out["first_word"] = piece, piece * capacity
        out["n_words"] = np.minimum(capacity, out.n_words - out.first_word)
        out = out.sort_values(["n_words", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        used = out.n_words > 0
        whole = [[None if pd.isna(v) else v for v in out[c][used]] for c in ("source", "cluster")]
        bins, offsets = best_fit(out.n_words[used].tolist(), *whole, capacity)
        out["bin"], out["bin_offset"] = None, pd.Series([None] * len(out), dtype="Int64")
        out.loc[used, "bin"] = [f"{out.shard[0]}-{out.part[0]}-{b}" for b in bins]
        out.loc[used, "bin_offset"] = offsets
        return out[["id", "piece", "first_word", "n_words", "bin", "bin_offset"]]

    shard = F.pmod(F.xxhash64("id", "cluster", "n_words"), F.lit(shards))
    dealt = items.select(F.col("id").cast("string").alias("id"), "source", "cluster", "n_words", shard.alias("shard"))
    large = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard_docs)
    large = staged(large.select("shard", F.ceil(F.col("n") / shard_docs).alias("parts")), "large-shards")
    if large.isEmpty():
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    else:
        dealt = dealt.withColumn("row", F.monotonically_increasing_id()).join(large, "shard", "left")
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0).cast("long"))).drop("row", "parts")
    packed = dealt.groupBy("shard", "part").applyInPandas(pack_shard, "id string, piece int, first_word long, n_words long, bin string, bin_offset long")
    return packed.withColumn("id", F.col("id").cast(id_type))
