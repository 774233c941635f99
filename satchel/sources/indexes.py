"""Indexes kept beside a point store: a word index and a cell index.

An index is a table of segments, one for each version of the store. A commit
writes the segment of its own version from the partitions it has rewritten,
before it is published, so a reader never sees a version without its index.
Rows of partitions that a later commit has replaced stay in their segments and
are told apart by the store's live list, which is joined on (version, project,
bucket). Nothing is rebuilt by a commit, and statistics change by the rows of
the touched partitions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.functions.text import tokens
from satchel.operators.ann import Cells, assign_cells, topk_in_cells, train_cells
from satchel.operators.bm25 import Weighing, occurrences
from satchel.operators.dense import dense_topk
from satchel.operators.lexical import parsed
from satchel.schema import POINT
from satchel.session import few_rows, local, small_splits, staged

if TYPE_CHECKING:
    from satchel.sources.store import PointStore

SPAN_DOCS = 1_024  # rows whose postings lie in one block
LITERALS = 64  # distinct words, or folders, that are named in a filter
FEW_WORDS = 20_000  # words of all questions that may be a local relation
_BLOCK = "project_key string, bucket int, span long, term string, docs array<int>, tfs array<int>, ids array<string>, lengths array<int>"
_TERM = "project_key string, bucket int, term string, df long, tf long, docs long, length long"
_VECTOR = "project_key string, bucket int, project_id string, id string, embedding array<float>"
_SPANS = -1  # folder of the rows that list the members of a span


class _Index:
    name: str
    tables: tuple[str, ...]
    setting: str

    def __init__(self, store: PointStore):
        self.store, self.spark = store, store.spark
        self._live_at: dict[int, list[int]] = {}
        held = self._settings(store, self.name)
        if held is None:
            raise ValueError(f"the store at {store.root} has no {self.name} index; create it first")
        self.size: int = held

    @staticmethod
    def _settings(store: PointStore, name: str) -> int | None:
        path, fs = store._folder(f"{store.root}/{name}-settings/_SUCCESS")
        if not fs.exists(path):
            return None
        return store.spark.read.schema("size int").parquet(f"{store.root}/{name}-settings").first()["size"]

    @classmethod
    def create(cls, store: PointStore, size: int, **options):
        """Add the index to a store: rows that are stored already are indexed
        now, later commits keep it up."""
        if cls._settings(store, cls.name) is not None:
            raise ValueError(f"the store at {store.root} has its {cls.name} index already")
        cls._prepare(store, size, **options)
        index = cls.__new__(cls)
        index.store, index.spark, index.size, index._live_at = store, store.spark, size, {}
        for version in index._versions():
            points = store._read("points", POINT, [r for r in store.live().where(F.col("version") == version).toLocalIterator()])
            index.write(points, version)
        store.spark.range(1).select(F.lit(size).alias("size")).write.mode("overwrite").parquet(f"{store.root}/{cls.name}-settings")
        return index

    @classmethod
    def _prepare(cls, store: PointStore, size: int) -> None:
        pass

    def write(self, points: DataFrame, version: int) -> None:
        raise NotImplementedError

    def _versions(self) -> list[int]:
        """Versions with live partitions; they number as the commits since the
        last time everything was rewritten. A published list never changes."""
        at = self.store.version()
        if at not in self._live_at:
            live = self.store.live(at).where("bucket >= 0").select("version").distinct()
            self._live_at = {at: sorted(r[0] for r in live.collect())}
        return self._live_at[at]

    def _alive(self, rows: DataFrame) -> DataFrame:
        at = next(iter(self._live_at), None)
        live = self.store.live(at).where("bucket >= 0").select(F.col("version").alias("v"), "project_key", "bucket")
        return rows.join(live, ["v", "project_key", "bucket"], "left_semi")

    def _segments(self, table: str, schema: str, folder: str) -> DataFrame:
        versions = self._versions()
        full = f"{schema}, v int, {folder} int"
        if not versions:
            return self.spark.createDataFrame([], full)
        base = f"{self.store.root}/{table}"
        return self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/v={v}" for v in versions])

    def _write(self, table: str, rows: DataFrame, folder: str, order: list[str], version: int, gather: bool = True) -> None:
        """Without ``gather`` each task writes its rows to the folders itself."""
        gathered = (rows.hint("rebalance", folder) if gather else rows).sortWithinPartitions(folder, *order)
        gathered.write.mode("overwrite").partitionBy(folder).parquet(f"{self.store.root}/{table}/v={version}")


def _key(project_id: Column) -> Column:
    return F.substring(F.sha2(project_id, 256), 1, 16)


class WordIndex(_Index):
    """Inverted index in folders by hash of the word.

    Rows of a bucket are numbered in spans of up to 1,024; a block holds the
    rows of a span that contain a word, as small numbers in order, with the
    word's count in each. All blocks of a span are comparable by their
    numbers, so a question's words are intersected span by span: a span where
    one of its words is missing falls away before any block is unfolded, and
    texts, ids and lengths are met for the rows left only. A question reads
    the folders of its own words. A second table holds, for each bucket and
    word, the number of rows and occurrences, and for each bucket the rows and
    their total length; sums over live buckets are the statistics of a project.
    """

    name, tables = "words", ("words", "terms")

    @classmethod
    def create(cls, store: PointStore, size: int = 16) -> WordIndex:
        return super().create(store, size)

    def _folder(self, term: Column) -> Column:
        return F.when(term.isNull(), F.lit(_SPANS)).otherwise(F.pmod(F.xxhash64(term), F.lit(self.size)).cast("int"))

    def write(self, points: DataFrame, version: int) -> None:
        rows = points.select("project_key", "bucket", "id", tokens(F.col("content")).alias("words"))
        blocks = rows.mapInArrow(_blocks, _BLOCK).withColumn("wb", self._folder(F.col("term")))
        # Blocks outweigh the texts they are made from and are not shuffled; counts
        # come from a shuffle by word already.
        with small_splits(self.spark):
            self._write("words", blocks, "wb", ["project_key", "term", "span"], version, gather=False)
        written = self.spark.read.schema(f"{_BLOCK}, wb int").parquet(f"{self.store.root}/words/v={version}")
        total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda t, x: t + x))
        size = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.size(c))).cast("long")
        counted = written.groupBy("wb", "project_key", "bucket", "term").agg(
            size("docs").alias("df"), total("tfs").alias("tf"), size("ids").alias("docs"), total("lengths").alias("length")
        )
        self._write("terms", counted, "wb", ["project_key", "term"], version, gather=False)

    def statistics(self, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(project_key, term, df, tf) and (project_key, n_docs, mean_length),
        from the maintained counts; ``terms`` (term) narrows the first."""
        rows = self._alive(self._segments("terms", _TERM, "wb"))
        words = rows.where(F.col("wb") != _SPANS)
        if terms is not None:
            words = words.join(terms.select("term", self._folder(F.col("term")).alias("wb")).distinct(), ["wb", "term"])
        words = words.groupBy("project_key", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        sizes = rows.where(F.col("wb") == _SPANS).groupBy("project_key").agg(
            F.sum("docs").alias("n_docs"), (F.sum("length") / F.sum("docs")).alias("mean_length")
        )
        return words, sizes

    def matches(self, queries: DataFrame, weigh: Weighing = occurrences) -> DataFrame:
        """query_id, project_id, id, lex_score of every row that holds all
        words of a question; the score is the sum of ``weigh`` over its words."""
        asked = parsed(queries)
        words = asked.select(
            "query_id", "project_id", _key(F.col("project_id")).alias("project_key"), F.size("terms").alias("n_terms"), F.explode("terms").alias("term")
        ).withColumn("wb", self._folder(F.col("term")))
        blocks = self._segments("words", _BLOCK, "wb")
        lists = blocks.where(F.col("wb") != _SPANS).select("v", "wb", "project_key", "bucket", "span", "term", "docs", "tfs")
        held = few_rows(words, FEW_WORDS)
        if held is not None:
            words = local(self.spark, held, words.schema)
            # Folders and words are named, so that files are chosen before any is opened.
            terms, folders = (sorted(set(held.column(c).to_pylist())) for c in ("term", "wb"))
            lists = lists.where(F.col("wb").isin(folders))
            if len(terms) <= LITERALS:
                lists = lists.where(F.col("term").isin(terms))
        if weigh.statistics:
            of_words, of_projects = self.statistics(words.select("term").distinct())
            words = words.join(of_words.select("project_key", "term", "df"), ["project_key", "term"]).join(of_projects, "project_key")
        else:
            words = words.withColumns({c: F.lit(None).cast("double") for c in ("df", "n_docs", "mean_length")})
        known = ["query_id", "project_id", "n_terms", "v", "span"]
        block = F.struct("docs", "tfs", "df", "n_docs", "mean_length")
        spans = (
            self._alive(lists)
            .join(words, ["wb", "project_key", "term"])
            .groupBy(*known)
            .agg(F.count("*").alias("n_found"), F.collect_list(block).alias("blocks"))
            .where(F.col("n_found") == F.col("n_terms"))
        )
        # Which rows are in all blocks; the shortest list leads.
        ordered = F.transform(F.sort_array(F.transform("blocks", lambda b: F.struct(F.size(b["docs"]).alias("n"), b["docs"].alias("docs")))), lambda x: x["docs"])
        common = F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.get(ordered, F.lit(0)), lambda kept, docs: F.array_intersect(kept, docs))
        spans = spans.withColumn("common", common).where(F.size("common") > 0)
        spans = staged(spans, "spans")
        members = blocks.where(F.col("wb") == _SPANS).select("v", "span", "ids", "lengths")
        where = spans.select("v", "span").distinct().limit(LITERALS + 1).collect()
        if len(where) <= LITERALS:
            members = members.where(F.col("v").isin(sorted({r["v"] for r in where})) & F.col("span").isin(sorted({r["span"] for r in where})))
        full = spans.join(members, ["v", "span"])
        unfolded = full.select("query_id", "project_id", "v", "span", "common", "ids", "lengths", F.explode("blocks").alias("b")).select(
            "query_id", "project_id", "v", "span", "common", "ids", "lengths", "b.df", "b.n_docs", "b.mean_length",
            F.explode(F.arrays_zip(F.col("b.docs").alias("doc"), F.col("b.tfs").alias("tf"))).alias("p"),
        ).where(F.array_contains("common", F.col("p.doc")))
        weight = weigh.weight(F.col("p.tf"), F.get("lengths", F.col("p.doc")), F.col("df"), F.col("n_docs"), F.col("mean_length"))
        scored = unfolded.groupBy("query_id", "project_id", "v", "span", F.get("ids", F.col("p.doc")).alias("id")).agg(F.sum(weight).alias("lex_score"))
        return scored.select("query_id", "project_id", "id", weigh.settled(F.col("lex_score")).alias("lex_score"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (project_key, bucket, id, words) as one block for each word of a
    span, and one row listing the members of the span."""
    span = TaskContext.get().partitionId() << 32
    for batch in batches:
        project = batch.column("project_key").dictionary_encode().indices.to_numpy().astype(np.int64)
        keys = (project << 32) + batch.column("bucket").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for start, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(batch)).tolist()):
            for at in range(start, end, SPAN_DOCS):
                yield from _span(batch.slice(at, min(SPAN_DOCS, end - at)), span)
                span += 1


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _span(batch: pa.RecordBatch, span: int) -> Iterator[pa.RecordBatch]:
    names = ["project_key", "bucket", "span", "term", "docs", "tfs", "ids", "lengths"]
    words = batch.column("words")
    lengths = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
    key, bucket = batch.column("project_key")[0], batch.column("bucket")[0].as_py()
    empty = pa.array([None], pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([key.as_py()]), pa.array([bucket], pa.int32()), pa.array([span]), pa.array([None], pa.string()), empty, empty,
            _lists(np.array([0, len(batch)]), batch.column("id")), _lists(np.array([0, len(batch)]), pa.array(lengths.astype(np.int32))),
        ],
        names=names,
    )
    encoded = words.flatten().dictionary_encode()
    if not len(encoded):
        return
    doc = np.repeat(np.arange(len(batch), dtype=np.int64), lengths)
    pairs, counts = np.unique(encoded.indices.to_numpy().astype(np.int64) * len(batch) + doc, return_counts=True)
    word, doc = pairs // len(batch), pairs % len(batch)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    ends = np.append(first, len(word))
    n = len(first)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([key.as_py()] * n), pa.array(np.full(n, bucket, dtype=np.int32)), pa.array(np.full(n, span)),
            encoded.dictionary.take(pa.array(word[first])), _lists(ends, pa.array(doc.astype(np.int32))), _lists(ends, pa.array(counts.astype(np.int32))),
            pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int32())),
        ],
        names=names,
    )


class CellIndex(_Index):
    """Vectors in folders by nearest centre.

    The centres are found once, by k-means over the vectors stored at the
    time, and kept with the index; a commit assigns its own vectors. A
    question names the folders of its nearest centres and scores their
    vectors exactly.
    """

    name, tables = "cells", ("cells",)

    @classmethod
    def create(cls, store: PointStore, size: int, seed: int = 7) -> CellIndex:
        return super().create(store, size, seed=seed)

    @classmethod
    def _prepare(cls, store: PointStore, size: int, seed: int = 7) -> None:
        cells = train_cells(store.points(), size, seed)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(cells.centres)]
        store.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{store.root}/centres")

    @cached_property
    def cells(self) -> Cells:
        """The centres; as many as the index was made with, and never changed."""
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.store.root}/centres").orderBy("cell").collect()
        return Cells(np.array([r["centre"] for r in rows]))

    def write(self, points: DataFrame, version: int) -> None:
        rows = assign_cells(points.select("project_key", "bucket", "project_id", "id", "embedding"), self.cells)
        self._write("cells", rows, "cell", ["project_key", "id"], version)

    def topk(self, queries: DataFrame, probes: int, k: str = "recall") -> DataFrame:
        """Best ``k`` rows of each question's project in the ``probes`` cells
        nearest to it; the scores are exact. Probing all cells is an exact
        search. A question may get fewer rows than a search of all would give."""
        rows = self._segments("cells", _VECTOR, "cell")
        asked = queries.select("query_id", "project_id", "qvec", k).where(F.col("qvec").isNotNull())
        few = few_rows(asked)
        if few is not None and few.num_rows:
            # Few questions are aimed on the driver.
            near = self.cells.order(few.column("qvec").combine_chunks())[:, :probes]
            aimed = few.take(pa.array(np.repeat(np.arange(len(near)), near.shape[1]))).append_column("cell", pa.array(near.ravel()))
            asked = local(self.spark, aimed, T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())]))
            folders, projects = set(near.ravel().tolist()), set(few.column("project_id").to_pylist())
        else:
            asked = asked.withColumn("cell", F.explode(self.cells.nearest(F.col("qvec"), probes)))
            # At most as many folders as there are centres.
            folders = {r[0] for r in asked.select("cell").distinct().collect()}
            projects = {r[0] for r in asked.select("project_id").distinct().limit(LITERALS + 1).collect()}
        rows = rows.where(F.col("cell").isin(sorted(folders)))
        if len(projects) <= LITERALS:
            rows = rows.where(F.col("project_id").isin(sorted(p for p in projects if p is not None)))
        return topk_in_cells(self._alive(rows), asked, k)

    def probes_for(self, recall: float, k: int = 10, sample: int = 256, asked: DataFrame | None = None) -> int:
        """The fewest probes that find this share of the ``k`` nearest rows, and
        ``k`` rows, or all there are, for each question that is measured.

        Measured on at most ``sample`` questions, chosen by a hash of their ids,
        against an exact search of the whole index: of those ``asked``
        (query_id, project_id, qvec) if there are any at hand, else on stored
        vectors. Questions may lie elsewhere than what is stored.
        """
        rows = self._alive(self._segments("cells", _VECTOR, "cell"))
        own = F.concat_ws("/", "project_id", "id")
        asked_for = asked is not None  # a stored vector finds itself as well
        if asked is None:
            asked = rows.select(own.alias("query_id"), "project_id", F.col("embedding").alias("qvec"))
            itself = own == F.col("query_id")
        else:
            itself = F.lit(False)
        some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "project_id", "qvec", F.lit(k + 1).alias("recall"))
        some = staged(some, "sample")
        nearest = dense_topk(rows, some).where(~itself)
        homes = nearest.join(rows.select("project_id", "id", "cell"), ["project_id", "id"])
        order = staged(some.select("query_id", "project_id", self.cells.nearest(F.col("qvec"), len(self.cells.centres)).alias("order")), "order")
        # At most ``sample`` questions with a row for each centre.
        steps = order.select("query_id", "project_id", F.posexplode("order").alias("step", "cell"))
        filled = steps.join(rows.groupBy("project_id", "cell").agg(F.count("*").alias("n")), ["project_id", "cell"], "left")
        of_question, held = Window.partitionBy("query_id", "project_id"), F.sum(F.coalesce("n", F.lit(0)))
        enough = held.over(of_question.orderBy("step")) >= F.least(held.over(of_question), F.lit(k if asked_for else k + 1))
        first = filled.withColumn("enough", enough).where("enough").groupBy("query_id", "project_id").agg(F.min("step").alias("step"))
        least = (first.agg(F.max("step")).first()[0] or 0) + 1
        place = homes.join(order.select("query_id", "order"), "query_id").groupBy(F.array_position("order", F.col("cell")).alias("probe")).agg(F.count("*").alias("n"))
        # One row for each centre at most.
        places = {r["probe"]: r["n"] for r in place.collect()}
        wanted, found = recall * sum(places.values()), 0
        for probes in range(1, len(self.cells.centres) + 1):
            found += places.get(probes, 0)
            if found >= wanted and probes >= least:
                return probes
        return len(self.cells.centres)


def kept_up(store: PointStore) -> list[_Index]:
    """The indexes that a store's commits have to write."""
    return [kind(store) for kind in (WordIndex, CellIndex) if kind._settings(store, kind.name) is not None]
