"""Benchmark decontamination by greedy string tiling.

Items and documents are sequences of words (letters and digits, A-Z lowered).
Runs of ``min_match`` words shared by an item and a document are seeds. For
every pair with enough seeds, tiles are laid: of all matches between words not
yet covered, found by their running Karp-Rabin hashes, the longest ones that
do not overlap are marked, until none of ``min_match`` words is left. An item
is leaked by a document if its tiles cover ``threshold`` of its words, in
whatever order the passages stand.

Benchmark items travel to the documents in blocks of bounded size, one pass
over the documents for each block (one in practice); every document meets
every item.

Defined results: null and empty texts match nothing, an item with fewer than
``min_match`` words is matched by its whole sequence; repeated documents give
repeated rows, repeated items count once; other columns are ignored. Whole documents are
tiled, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.words import ALNUM, Words, blocks, runs, text_bytes

MIN_MATCH = 5
THRESHOLD = 0.6
BENCH_BYTES = 4 << 20  # texts of a block of items


def running_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words."""
    return runs(tokens, np.array([0, len(tokens)]), size)[0]


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (item start, doc start, length),
    longest first; among equals the first in the item, then in the document."""
    m = min(min_match, len(item))
    if not m or len(doc) < m:
        return []
    own, other = running_hashes(item, m), running_hashes(doc, m)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], other, "left"), np.searchsorted(own[order], other, "right")
    j = np.repeat(np.arange(len(other)), hi - lo)
    i = order[np.arange(len(j)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)] if len(j) else j
    used_item, used_doc, out = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool), []
    while len(i):
        # Seeds that follow each other on a diagonal are one match.
        at = np.lexsort((i, j - i))
        i, j = i[at], j[at]
        head = np.ones(len(i), dtype=bool)
        head[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        begin = np.flatnonzero(head)
        length = np.diff(np.append(begin, len(i))) + m - 1
        longest = int(length.max())
        best = begin[length == longest]
        for k in best[np.lexsort((j[best], i[best]))]:
            a, b = int(i[k]), int(j[k])
            if not used_item[a : a + longest].any() and not used_doc[b : b + longest].any():
                used_item[a : a + longest] = used_doc[b : b + longest] = True
                out.append((a, b, longest))
        # Seeds with a covered word are gone.
        busy_item = np.convolve(used_item, np.ones(m, dtype=int))[m - 1 : len(used_item)] > 0
        total = np.append(0, np.cumsum(used_doc))
        busy_doc = total[m:] - total[:-m] > 0
        free = ~(busy_item[i] | busy_doc[j])
        i, j = i[free], j[free]
    return out


def _items(benchmark: DataFrame, block: int, n_blocks: int, id_col: str, text_col: str) -> tuple[list, list[np.ndarray]]:
    mine = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block)
    rows = mine.toArrow()
    data, offsets = text_bytes(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes
    return rows.column("id").to_pylist(), [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
    doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, longest_tile) of
    every document that holds at least ``threshold`` of an item's words."""
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((docs, doc_id), (benchmark, item_id))}
    benchmark = benchmark.select(item_id, text_col).dropDuplicates()
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0)).alias("b")).first()["b"]
    n_blocks = int(size // BENCH_BYTES) + 1
    schema = f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {kinds[item_id]}, item_words int, covered_words int, n_tiles int, longest_tile int"
    passes = [_one_block(docs, _items(benchmark, b, n_blocks, item_id, text_col), threshold, min_match, doc_id, text_col, schema) for b in range(n_blocks)]
    out = passes[0]
    for more in passes[1:]:
        out = out.union(more)
    return out


def _one_block(docs, items, threshold, min_match, doc_id, text_col, schema) -> DataFrame:
    ids, sequences = items
    # Seeds of the block's items: sorted hashes, and the item and place of each.
    short = [k for k, s in enumerate(sequences) if 0 < len(s) < min_match]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for m in sorted({min_match, *(len(sequences[k]) for k in short)}):
        which = short if m < min_match else range(len(sequences))
        which = [k for k in which if (len(sequences[k]) == m if m < min_match else len(sequences[k]) >= m)]
        found = [running_hashes(sequences[k], m) for k in which]
        values = np.concatenate([np.zeros(0, np.uint64), *found])
        owner = np.repeat(np.array(which, dtype=np.int64), [len(f) for f in found])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(f)) for f in found]])
        order = np.argsort(values, kind="stable")
        seeds[m] = values[order], owner[order], place[order]
    shared = docs.sparkSession.sparkContext.broadcast((ids, sequences, seeds))
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sequences, seeds = shared.value
        for block in blocks(batches, text_col):
            words = Words(*text_bytes(block.column(text_col)), ALNUM)
            hashes, rows = words.hashes, []
            for m, (values, owner, place) in seeds.items():
                if not len(values):
                    continue
                here, begins = runs(hashes, words.first, m)
                lo = np.searchsorted(values, here, "left")
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == here)
                lo, doc = lo[hit], words.doc[begins[hit]]
                n = np.searchsorted(values, here[hit], "right") - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                trio = np.unique(np.column_stack([np.repeat(doc, n), owner[at], place[at]]), axis=0)
                if not len(trio):
                    continue
                cut = np.flatnonzero(np.append(True, (trio[1:, :2] != trio[:-1, :2]).any(axis=1)))
                for a, b in zip(cut, np.append(cut[1:], len(trio))):
                    d, k, places = int(trio[a, 0]), int(trio[a, 1]), trio[a:b, 2]
                    item = sequences[k]
                    # Words of the item in any seed: more can't be covered.
                    most = m + np.minimum(np.diff(places), m).sum()
                    if most < threshold * len(item):
                        continue
                    laid = tiles(item, hashes[words.first[d] : words.first[d + 1]], m)
                    covered = sum(t[2] for t in laid)
                    if covered >= threshold * len(item):
                        rows.append((d, k, len(item), covered, len(laid), max(t[2] for t in laid)))
            if rows:
                d, k, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [block.column(doc_id).take(pa.array(d)), pa.array([ids[x] for x in k]), *[pa.array(r, pa.int32()) for r in rest]], names
                )

    return docs.select(doc_id, text_col).mapInArrow(search, schema)
