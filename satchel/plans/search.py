"""Answering a batch of questions: recall, fuse, rerank, cut, compress."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.functions.meta import or_default
from satchel.operators.bm25 import Weighing, occurrences
from satchel.operators.compress import compress
from satchel.operators.dense import dense_topk
from satchel.operators.embedding import hash_embedding
from satchel.operators.fusion import best_fused, fuse
from satchel.operators.lexical import lexical_matches, lexical_topk
from satchel.operators.rerank import Scorer, apply_hits, hits_of, reorder_by, rerank_calls
from satchel.operators.usage import record_usage
from satchel.session import SMALL_BYTES, SMALL_ROWS, broadcast_if_small, few_rows, is_small, local, planned_bytes, staged
from satchel.sources.indexes import CellIndex, WordIndex
from satchel.sources.store import place

DEFAULT_K = 5
DEFAULT_RECALL = 40
DEFAULT_PROBES = 4


def with_defaults(queries: DataFrame) -> DataFrame:
    """Fill the options of a question: k 5, recall 40, hybrid and rerank on,
    compress off. Missing option columns take the default throughout."""

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind)

    return (
        queries.withColumn("k", or_default(given("k", "int"), DEFAULT_K))
        .withColumn("recall", or_default(given("recall", "int"), DEFAULT_RECALL))
        .withColumn("hybrid", F.coalesce(given("hybrid", "boolean"), F.lit(True)))
        .withColumn("rerank", F.coalesce(given("rerank", "boolean"), F.lit(True)))
        .withColumn("compress", F.coalesce(given("compress", "boolean"), F.lit(False)))
    )


def embed_queries(queries: DataFrame, dim: int = 64, query_fn=None, fn=None) -> DataFrame:
    """Add ``qvec``: by the query-side encoder if there is one, else by the
    document encoder, else by the built-in one."""
    from satchel.operators.embedding import embed

    chosen = query_fn or fn
    if chosen is None:
        return queries.withColumn("qvec", hash_embedding(F.col("query"), dim))
    return embed(queries, chosen, text="query", into="qvec", used="query_tokens")


def candidates(
    queries: DataFrame,
    points: DataFrame,
    postings: DataFrame | None = None,
    words: WordIndex | None = None,
    cells: CellIndex | None = None,
    probes: int = DEFAULT_PROBES,
    weigh: Weighing = occurrences,
    held: pa.Table | None = None,
) -> DataFrame:
    """Up to ``recall`` rows per question: query_id, project_id, id, score,
    rank, in_dense, in_lexical. ``held`` are the questions, if they are few.

    Texts and metadata stay behind; they are fetched for the few survivors.
    """
    if held is not None:
        modes = set(held.column("hybrid").to_pylist())
        bounds = pc.min_max(held.column("recall")).as_py()
        bounds = (bounds["min"], bounds["max"])
    else:
        modes = {r[0] for r in queries.select("hybrid").distinct().collect()}
        bounds = None
    dense = dense_topk(points, queries) if cells is None else cells.topk(queries, probes)
    no = F.lit(False)
    plain = dense.select("query_id", "project_id", "id", "score", "rank", no.alias("in_dense"), no.alias("in_lexical"))
    if True not in modes:
        return plain
    if False in modes:
        # Both kinds of question read the same dense lists.
        dense = staged(dense, "dense")
    asked = queries.where("hybrid")
    found = lexical_matches(asked, points, postings, weigh) if words is None else words.matches(asked, weigh)
    lexical = lexical_topk(found, asked, bounds_of=bounds)
    fused = best_fused(fuse(dense.join(asked.select("query_id"), "query_id", "left_semi"), lexical), asked)
    fused = fused.select(*plain.columns)
    if False not in modes:
        return fused
    rest = queries.where(~F.col("hybrid")).select("query_id")
    kept = dense.withColumn("in_dense", no).withColumn("in_lexical", no).select(*plain.columns)
    return fused.unionByName(kept.join(rest, "query_id", "left_semi"))


def hydrate(found: DataFrame, points: DataFrame, columns: list[str], buckets: int | None = None, small: bool | None = None) -> DataFrame:
    """Attach stored columns to found rows; the found side is the small one.
    ``small`` says whether it may be broadcast, where that is known.

    With the bucket count of the store the partitions of the found rows are
    known too, and a broadcast join reads only those.
    """
    keys = ["project_id", "id"]
    if buckets and "bucket" in points.columns:
        found = place(found, buckets)
        keys += ["project_key", "bucket"]
    small = is_small(found) if small is None else small
    joined = points.select(*keys, *columns).join(F.broadcast(found) if small else found, keys)
    return joined.drop("project_key", "bucket")


@dataclass(frozen=True)
class Answer:
    """``results`` per question in rank order and the ``candidates`` they came
    from, with the questions as asked."""

    queries: DataFrame
    candidates: DataFrame
    results: DataFrame
    calls: DataFrame | None = None  # of a scoring function: hits, tokens and error of each question

    def composition(self) -> DataFrame:
        """What each question's answer was made of; questions without any
        candidate have zeros. Origin counts are over the candidates."""
        found = self.candidates.groupBy("query_id").agg(
            F.count("*").alias("candidates"),
            F.count_if("in_dense").alias("dense_count"),
            F.count_if("in_lexical").alias("lexical_count"),
        )
        kept = self.results.groupBy("query_id").agg(
            F.count("*").alias("results"), F.max("reranked").alias("reranked"), F.max("rerank_moved").alias("rerank_moved")
        )
        counts = ("candidates", "results", "dense_count", "lexical_count", "rerank_moved")
        rows = self.queries.select("query_id", "hybrid").join(found, "query_id", "left").join(kept, "query_id", "left")
        reranked = F.coalesce("reranked", F.lit(False))
        if self.calls is not None:
            # Hits that all point nowhere make an empty, reranked answer.
            rows = rows.join(self.calls.where(F.size("hits") > 0).select("query_id", F.lit(True).alias("_called")), "query_id", "left")
            reranked = reranked | F.coalesce("_called", F.lit(False))
        return (
            rows.select(
                "query_id",
                "hybrid",
                reranked.alias("reranked"),
                *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in counts],
            )
        )


def search(
    queries: DataFrame,
    points: DataFrame,
    postings: DataFrame | None = None,
    scorer: Scorer | Column | None = None,
    extra: tuple[str, ...] = (),
    buckets: int | None = None,
    words: WordIndex | None = None,
    cells: CellIndex | None = None,
    probes: int = DEFAULT_PROBES,
    weigh: Weighing = occurrences,
    counts_tokens: bool = False,
    usage: str | None = None,
) -> Answer:
    """Run every question (QUERY rows with ``qvec``) against its project.

    With the ``words`` index of the store lexical matches come from the folders
    of the asked words; ``weigh`` says what a word is worth. With its ``cells``
    index the dense part looks at the ``probes`` nearest cells of a question
    only, so it may miss rows that an exact search finds. A scoring function
    that returns hits and tokens (``counts_tokens``) has its tokens added to the
    ``usage`` log; calls that failed are told in ``Answer.calls``.

    ``scorer`` is a function over a question's candidates, or an expression
    over ``query`` and ``content``; without one nothing is reranked.
    ``buckets`` is the bucket count of the store the points come from.
    """
    asked = with_defaults(queries)
    held = few_rows(asked)
    # A few questions stay on the driver, where what is asked of them costs no job.
    asked = staged(asked, "questions") if held is None else local(asked.sparkSession, held, asked.schema)
    found = staged(candidates(asked, points, postings, words, cells, probes, weigh, held), "candidates")
    # Few questions have at most so many candidates, and their files have a size.
    small = None
    if held is not None and planned_bytes(found) <= SMALL_BYTES // 8:
        small = (pc.sum(held.column("recall")).as_py() or 0) <= SMALL_ROWS or None
    # The question's text is only carried along for a scorer.
    options = asked.select("query_id", "k", "rerank", "compress", *(["query"] if scorer is not None else []))
    stored = ["content", "content_hash", *[c for c in extra if c not in ("content", "content_hash")]]
    first_k = F.col("rank") <= F.col("k")
    # Only questions that want a rerank need the text of all their candidates.
    needed = first_k if scorer is None else F.col("rerank") | first_k
    options = broadcast_if_small(options) if held is None else F.broadcast(options)
    full = hydrate(found.join(options, "query_id").where(needed), points, stored, buckets, small)
    calls = None
    if scorer is None:
        ranked = full.withColumn("reranked", F.lit(False)).withColumn("moved", F.lit(False))
    elif isinstance(scorer, Column):
        ranked = reorder_by(full, scorer)
    else:
        # The texts go to the scorer once and are then read again in its order.
        full = staged(full, "candidate-texts")
        calls = staged(rerank_calls(full.where("rerank"), scorer, counts_tokens=counts_tokens), "rerank-calls")
        if usage is not None:
            spent = calls.agg(F.sum("tokens").alias("tokens")).first()["tokens"] or 0
            record_usage(calls.sparkSession, usage, "rerank", spent)
        ranked = apply_hits(full, hits_of(calls))
    moved = F.sum(F.col("moved").cast("int")).over(Window.partitionBy("query_id")).cast("int")
    ranked = ranked.withColumn("rerank_moved", moved)
    if pc.any(held.column("compress")).as_py() if held is not None else not asked.where("compress").isEmpty():
        ranked = compress(ranked, flag="compress")
    return Answer(asked, found, ranked.drop("query", "k", "rerank", "compress", "moved"), calls)
