"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each model sees, besides the
words of the text and their begins (inflected and compound forms share them), the probabilities of the categories before it. While the
chain is fitted those probabilities come from models that have not seen the
row (out-of-fold), so a later model does not learn to trust an earlier one
more than it will deserve.

Defined results: a null or empty text has no words and gets the base rates; a
null label leaves its row out, of rows that repeat an id the largest label
and one text count; without any labelled row, or with one class
only, a category has a constant probability and nothing is rejected for it.
Whole texts are scored; a repeated word counts once, so a long text is neither
favoured nor diluted. Repeated rows get equal scores, extra columns are kept
by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.words import ALNUM, Words, blocks, text_bytes

FIT_ROWS = 5_000  # labelled rows used for fitting, at most
VOCABULARY = 100_000  # words and word begins a model may look at, at most
PREFIXES = (4, 5)  # begins of words, in bytes, that count as words do
LEAST_Z = 3.0  # deviation of a word's rate, in the rows fitted, that lets it in
MIN_ROWS = 5  # rows a word must occur in
FOLDS = 4


def _word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word or word begin) pairs of a block, each once."""
    words = Words(data, offsets, ALNUM)
    doc, hashes = (np.concatenate(x) for x in zip((words.doc, words.hashes), *[words.prefixes(k) for k in PREFIXES]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Rows:
    """Sparse rows: words present (columns of the vocabulary) and dense extras."""

    row: np.ndarray
    col: np.ndarray
    n: int
    width: int
    extra: np.ndarray

    def pick(self, keep: np.ndarray) -> Rows:
        at = np.cumsum(keep) - 1
        use = keep[self.row]
        return Rows(at[self.row[use]], self.col[use], int(keep.sum()), self.width, self.extra[keep])

    def dot(self, w: np.ndarray) -> np.ndarray:
        words, extras = w[: self.width], w[self.width : -1]
        return np.bincount(self.row, words[self.col], self.n) + self.extra @ extras + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, g[self.row], self.width), g @ self.extra, [g.sum()]])


def fit_linear(x: Rows, y: np.ndarray, penalty: float = 2e-4, steps: int = 200) -> np.ndarray:
    """Logistic regression with an L1 penalty on the words, by accelerated
    proximal steps; words whose rate hardly differs between the classes stay
    out. One class only: its (smoothed) rate as a constant."""
    w = np.zeros(x.width + x.extra.shape[1] + 1)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if y.min(initial=1) == y.max(initial=0):
        return w
    n, p = np.bincount(x.col, minlength=x.width), y.mean()
    z = (np.bincount(x.col, y[x.row], x.width) - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    use = (np.abs(z) >= LEAST_Z)[x.col]
    x = Rows(x.row[use], x.col[use], x.n, x.width, x.extra)
    v = np.random.default_rng(1).random(len(w))
    for _ in range(12):  # largest curvature, by power iteration
        v = x.back(x.dot(v)) / len(y)
        v /= (norm := np.linalg.norm(v))
    step, z, t = 4 / (1.1 * norm), w.copy(), 1.0
    for _ in range(steps):
        new = z - step * x.back(_sigmoid(x.dot(z)) - y) / len(y)
        new[: x.width] = np.sign(new[: x.width]) * np.maximum(np.abs(new[: x.width]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (old - 1) / t * (new - w), new
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of highest F1, in the middle of the gap it lies in."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    k = int(np.argmax(f1))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


@dataclass
class Chain:
    categories: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def rows(self, doc: np.ndarray, hashes: np.ndarray, n: int) -> Rows:
        at = np.searchsorted(self.vocabulary, hashes).astype(np.int32)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == hashes[known]
        return Rows(doc[known], at[known], n, len(self.vocabulary), np.zeros((n, 0)))

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, one column for each category."""
        for w in self.weights:
            p = _sigmoid(rows.dot(w))
            rows = Rows(rows.row, rows.col, rows.n, rows.width, np.column_stack([rows.extra, p]))
        return rows.extra

    def score_texts(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        return self.predict(self.rows(*_word_sets(data, offsets), len(column)))


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id",
    text_col: str = "text", max_rows: int = FIT_ROWS, folds: int = FOLDS,
) -> Chain:
    """Fit a chain on at most ``max_rows`` labelled rows, those of smallest
    hashed id. Executors reduce texts to sets of word hashes; the driver gets
    no more than those of the bounded sample."""
    wanted = labels.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(categories)])
    names = [f"_y{i}" for i in range(len(categories))]
    wanted = wanted.dropna().groupBy("_id").agg(*[F.max(c).alias(c) for c in names]).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            doc, hashes = _word_sets(*text_bytes(block.column("_text")))
            cut = np.searchsorted(doc, np.arange(block.num_rows + 1))
            words = pa.array([hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("_id").cast(pa.string()), words, *[block.column(c) for c in names]], ["_id", "_words", *names])

    got = sample.select("_id", "_text", *names).mapInArrow(reduce, "_id string, _words binary, " + ", ".join(f"{c} double" for c in names))
    got = got.groupBy("_id").agg(F.max(F.struct("_words", *names)).alias("r")).select("_id", "r.*")
    found = got.select("_id", "_words", *names).toArrow()
    found = found.take(pc.sort_indices(found.column("_id").combine_chunks())) if found.num_rows else found
    y = np.column_stack([found.column(c).to_numpy() > 0 for c in names]).astype(float)
    sets = [np.frombuffer(b.as_buffer(), dtype=np.uint64) for b in found.column("_words")]
    everything, sizes = np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), [len(s) for s in sets]
    del found, sets
    words, counts = np.unique(everything, return_counts=True)
    often = counts >= MIN_ROWS
    words, counts = words[often], counts[often]
    chain = Chain(list(categories), np.sort(words[np.argsort(-counts, kind="stable")[:VOCABULARY]]))
    if not sizes:
        chain.weights = [np.concatenate([np.zeros(i), [-35.0]]) for i in range(len(categories))]
        chain.thresholds = [1.0] * len(categories)
        return chain
    rows = chain.rows(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), everything, len(sizes))
    del everything
    fold = np.arange(len(sizes)) % max(2, folds)
    for i in range(len(categories)):
        unseen = np.zeros(len(sizes))
        for k in range(max(2, folds)):
            if (fold == k).any() and (fold != k).any():
                unseen[fold == k] = _sigmoid(rows.pick(fold == k).dot(fit_linear(rows.pick(fold != k), y[fold != k, i])))
        chain.weights.append(fit_linear(rows, y[:, i]))
        chain.thresholds.append(best_threshold(unseen, y[:, i]) if 0 < y[:, i].sum() < len(y) else 1.0)
        rows = Rows(rows.row, rows.col, rows.n, rows.width, np.column_stack([rows.extra, unseen]))
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., <last category> as boolean) of every text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out = [id_col, *[f"p_{c}" for c in chain.categories], f"is_{chain.categories[-1]}"]
    cut = chain.thresholds[-1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            p = chain.score_texts(block.column(text_col))
            yield pa.RecordBatch.from_arrays([block.column(id_col), *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= cut)], out)

    kinds = [id_type, *["double"] * len(chain.categories), "boolean"]
    return docs.select(id_col, text_col).mapInArrow(scored, ", ".join(f"`{n}` {k}" for n, k in zip(out, kinds)))


def reject(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""
    cut = chain.thresholds[-1]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            yield block.filter(pa.array(chain.score_texts(block.column(text_col))[:, -1] < cut))

    return docs.mapInArrow(clean, docs.schema)
