"""Lexical matching: every distinct word of a question must occur.

Candidates come from the rarest word of each question only, so a word that
sits in most rows never drives a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.functions.text import query_terms, tokens
from satchel.operators.bm25 import Weighing, occurrences
from satchel.operators.ranking import best_per_group, dense_order
from satchel.session import SMALL_BYTES, SMALL_ROWS, broadcast_if_small, row_bytes, staged

# Words of all questions together that may be broadcast.
SMALL_WORDS = 500_000
# Distinct words that are tested by equality in the scan of stored postings.
PUSHED_WORDS = 64
_POSTED = "term string, tf bigint, positions array<int>"


def build_postings(points: DataFrame, content: str = "content", carried: Sequence[str] = ()) -> DataFrame:
    """Inverted rows: project_id, id, term, tf, positions, and the ``carried``
    columns of the text's row.

    A text is one row, so its words are grouped inside the Arrow batch that
    holds it and nothing is shuffled. Rows come in word order for each run of
    equal carried values, so that a sort by those and the word has little to do.
    """
    words = points.select("project_id", "id", tokens(F.col(content)).alias("words"), *carried)
    schema = T.StructType([words.schema[c] for c in ("project_id", "id")] + list(T._parse_datatype_string(_POSTED).fields) + [words.schema[c] for c in carried])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _invert(batch, carried)

    return words.mapInArrow(invert, schema)


def _runs(batch: pa.RecordBatch, columns: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of each run of rows with equal values in ``columns``."""
    starts = np.zeros(len(batch), dtype=bool)
    starts[:1] = True
    for c in columns:
        codes = batch.column(c).dictionary_encode("encode").indices.to_numpy()
        starts[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(starts).tolist()
    return list(zip(at, [*at[1:], len(batch)]))


def _invert(batch: pa.RecordBatch, carried: Sequence[str]) -> Iterator[pa.RecordBatch]:
    lists = batch.column("words")
    # A row without a text has no words, whatever its place in the list says.
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    total = int(lengths.sum())
    if total == 0:
        return
    row = np.repeat(np.arange(len(batch), dtype=np.int64), lengths)
    position = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    encoded = lists.flatten().dictionary_encode()
    # Words as numbers in their order.
    by_word = pc.sort_indices(encoded.dictionary).to_numpy()
    place = np.empty(len(by_word), dtype=np.int64)
    place[by_word] = np.arange(len(by_word))
    word, dictionary = place[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(by_word))
    ends = np.cumsum(lengths)
    for start, end in _runs(batch, carried):
        first, last = int(ends[start] - lengths[start]), int(ends[end - 1])
        if first < last:
            yield _posted(batch, row[first:last], word[first:last], position[first:last], dictionary, carried)


def _posted(batch: pa.RecordBatch, row: np.ndarray, word: np.ndarray, position: np.ndarray, dictionary: pa.Array, carried: Sequence[str]) -> pa.RecordBatch:
    key = word * len(batch) + row
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends = np.append(first[1:], len(key))
    rows, words = pa.array(row[order][first]), pa.array(word[order][first])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(position[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("project_id").take(rows), batch.column("id").take(rows), dictionary.take(words), pa.array(ends - first), lists,
            *[batch.column(c).take(rows) for c in carried],
        ],
        names=["project_id", "id", "term", "tf", "positions", *carried],
    )


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, project_id, terms; questions without a word match nothing."""
    return queries.select("query_id", "project_id", query_terms(F.col("query")).alias("terms")).where(
        F.size("terms") > 0
    )


def lexical_matches(
    queries: DataFrame, points: DataFrame | None = None, postings: DataFrame | None = None, weigh: Weighing = occurrences
) -> DataFrame:
    """query_id, project_id, id, lex_score: the sum of ``weigh`` over the
    question's words, their total occurrences as a rule.

    With stored postings only the rows of the asked words are read. Without,
    the texts are tokenised on the fly, in one pass for word frequencies and
    one for matching, and nothing but matches is shuffled. A weighing that
    needs statistics is answered from the texts, or by a word index, which
    has them at hand (``WordIndex.matches``).
    """
    asked = parsed(queries)
    if weigh.statistics:
        if points is None:
            raise ValueError("weights by statistics need the texts or a word index")
        return _weighed(asked, points, weigh)
    if postings is not None:
        return _from_postings(asked, postings)
    if points is None:
        raise ValueError("either points or postings are needed")
    return lexical_matches_plain(asked, points)


def lexical_matches_plain(asked: DataFrame, points: DataFrame) -> DataFrame:
    """Matches of parsed questions from the texts, by occurrences."""
    size = asked.agg(
        F.count("*").alias("questions"), F.sum(F.size("terms")).alias("words"), F.sum(row_bytes(asked)).alias("bytes")
    ).first()
    if size["questions"] <= SMALL_ROWS and (size["words"] or 0) <= SMALL_WORDS and (size["bytes"] or 0) <= SMALL_BYTES:
        return _from_texts(asked, points)
    return _from_postings(asked, build_postings(points))


def _rarest(asked: DataFrame, frequency: DataFrame) -> DataFrame:
    """The least frequent word of each question. A word absent from the
    project rules its question out, so its lack of a frequency row drops it."""
    words = asked.select("query_id", "project_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    known = words.join(frequency, ["project_id", "term"])
    picked = known.groupBy("query_id", "project_id", "n_terms").agg(
        F.count("*").alias("n_known"), F.min(F.struct("df", "term")).alias("pick")
    )
    return picked.where(F.col("n_known") == F.col("n_terms")).select(
        "query_id", "project_id", F.col("pick.term").alias("term")
    )


def _from_texts(asked: DataFrame, points: DataFrame) -> DataFrame:
    texts = points.select("project_id", "id", tokens(F.col("content")).alias("words"))
    # At most SMALL_ROWS questions and SMALL_WORDS words, checked by the caller.
    vocabulary = asked.select("project_id", F.explode("terms").alias("term")).distinct()
    frequency = (
        texts.select("project_id", F.explode(F.array_distinct("words")).alias("term"))
        .join(F.broadcast(vocabulary), ["project_id", "term"])
        .groupBy("project_id", "term")
        .agg(F.count("*").alias("df"))
    )
    lead = _rarest(asked, frequency).join(asked.select("query_id", "terms"), "query_id")
    # Each word of a text probes the leading words; only a hit is looked at
    # further, next to the words of its text.
    both = (
        texts.select("project_id", "id", "words", F.explode(F.array_distinct("words")).alias("term"))
        .join(F.broadcast(lead), ["project_id", "term"])
        .where(F.size(F.array_except("terms", "words")) == 0)
    )
    occurrences = F.size(F.filter("words", lambda w: F.array_contains(F.col("terms"), w)))
    return both.select("query_id", "project_id", "id", occurrences.cast("long").alias("lex_score"))


def _weighed(asked: DataFrame, points: DataFrame, weigh: Weighing) -> DataFrame:
    """Matches from the texts, then the weight of each word in each match."""
    texts = points.select("project_id", "id", tokens(F.col("content")).alias("words"))
    words = asked.select("query_id", "project_id", F.explode("terms").alias("term"))
    vocabulary = words.select("project_id", "term").distinct()
    seen = texts.select("project_id", F.explode(F.array_distinct("words")).alias("term"))
    frequency = seen.join(broadcast_if_small(vocabulary), ["project_id", "term"]).groupBy("project_id", "term").agg(F.count("*").alias("df"))
    sizes = texts.groupBy("project_id").agg(F.count("*").alias("n_docs"), F.avg(F.size("words")).alias("mean_length"))
    found = lexical_matches_plain(asked, points).join(texts, ["project_id", "id"])
    tf = F.size(F.filter("words", lambda w: w == F.col("term")))
    each = found.join(words, ["query_id", "project_id"]).select("query_id", "project_id", "id", "term", tf.alias("tf"), F.size("words").alias("length"))
    weight = weigh.weight(F.col("tf"), F.col("length"), F.col("df"), F.col("n_docs"), F.col("mean_length"))
    scored = each.join(frequency, ["project_id", "term"]).join(sizes, "project_id").groupBy("query_id", "project_id", "id").agg(F.sum(weight).alias("lex_score"))
    return scored.select("query_id", "project_id", "id", weigh.settled(F.col("lex_score")).alias("lex_score"))


def _from_postings(asked: DataFrame, postings: DataFrame) -> DataFrame:
    words = asked.select("query_id", "project_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))
    vocabulary = words.select("project_id", "term").distinct()
    few = [r["term"] for r in vocabulary.select("term").distinct().limit(PUSHED_WORDS + 1).collect()]
    if 0 < len(few) <= PUSHED_WORDS:
        # Stored postings lie in word order, so equality tests skip most of them.
        postings = postings.where(reduce(or_, [F.col("term") == w for w in few]))
    relevant = postings.select("project_id", "id", "term", "tf").join(
        broadcast_if_small(vocabulary), ["project_id", "term"], "left_semi"
    )
    # Read three times; postings made on the fly would be made three times.
    relevant = staged(relevant, "asked-postings")
    frequency = relevant.groupBy("project_id", "term").agg(F.count("*").alias("df"))
    lead = _rarest(asked, frequency)
    start = relevant.join(broadcast_if_small(lead), ["project_id", "term"]).select(
        "query_id", "project_id", "id", F.col("term").alias("lead"), F.col("tf").alias("lead_tf")
    )
    # The other words are looked up by (word, row), a key no word can dominate.
    others = start.join(words, ["query_id", "project_id"]).where(F.col("term") != F.col("lead"))
    found = others.join(relevant, ["project_id", "id", "term"]).groupBy("query_id", "project_id", "id").agg(
        F.count("*").alias("n_found"), F.sum("tf").alias("tf")
    )
    sizes = asked.select("query_id", F.size("terms").alias("n_terms"))
    return (
        start.join(found, ["query_id", "project_id", "id"], "left")
        .join(sizes, "query_id")
        .where(F.coalesce("n_found", F.lit(0)) + 1 == F.col("n_terms"))
        .select(
            "query_id", "project_id", "id", (F.col("lead_tf") + F.coalesce("tf", F.lit(0))).cast("long").alias("lex_score")
        )
    )


def lexical_topk(matches: DataFrame, queries: DataFrame, k: str = "recall", bounds_of: tuple[int, int] | None = None) -> DataFrame:
    """Best matches of each question by lexical score, ties in id order.
    ``bounds_of`` are the least and the largest ``k``, where they are known."""
    bounds = queries.select("query_id", F.col(k).alias("_k"))
    least, most = bounds_of or bounds.agg(F.min("_k"), F.max("_k")).first()
    ranked = best_per_group(matches, ["query_id"], dense_order("lex_score"), most or 1, spread=16)
    if most == least:
        return ranked
    return ranked.join(bounds, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
