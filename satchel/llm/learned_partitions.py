"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (``SAMPLE_ROWS``, those of smallest hashed id)
gives a neighbour graph, which is cut into parts of equal size by repeated
bisection: a slow direction of a walk on the graph, split at its median, then
swaps of nodes that cut fewer edges. A small network learns the part of a
vector; it places every row of the table in its most probable part and sends a
query to several. How many is the least that finds ``TARGET`` of the
neighbours among held-out rows of the sample. Candidates are ranked by their exact
distances on the original vectors.

Parts are worked in blocks of bounded size on both sides, so a part that holds
a third of all rows is spread over many tasks. Equal vectors of a block are
measured once. A query that found fewer than it could is asked again of all parts.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, neither as query nor as
candidate; ties go to the smaller id; of rows that repeat an id all are
candidates, but none of them for a query of that id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from satchel.session import staged

SAMPLE_ROWS = 4_096
PART_ROWS = 2_048  # rows of a part that the number of parts aims at
MAX_PARTS = 256
NEIGHBOURS = 10
TARGET = 0.94
BLOCK_ROWS = 16_384


def nearest(x: np.ndarray, queries: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Row numbers of the ``k`` nearest rows of ``x`` for each query."""
    out, norms = [], (x * x).sum(1)
    for at in range(0, len(queries), 512):
        far = norms - 2 * queries[at : at + 512] @ x.T
        if skip_self:
            far[np.arange(len(far)), at + np.arange(len(far))] = np.inf
        some = np.argpartition(far, min(k, far.shape[1]) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def bisect(rows: np.ndarray, cols: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two halves of a graph of ``n`` nodes (edges both ways), as booleans."""
    degree = np.maximum(np.bincount(rows, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(60):
        v = 0.5 * v + 0.5 * np.bincount(rows, v[cols], n) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(12):  # swap the nodes of either half that gain most
        across = np.bincount(rows, side[rows] != side[cols], n)
        gain = 2 * across - np.bincount(rows, minlength=n)
        a, b = (np.flatnonzero(side == s) for s in (True, False))
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        if not good:
            break
        side[a[:good]], side[b[:good]] = False, True
    return side


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node of a neighbour graph (node by neighbour); ``parts`` is a power of two."""
    n, rng = len(graph), np.random.default_rng(seed)
    rows, cols = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    rows, cols = np.concatenate([rows, cols]), np.concatenate([cols, rows])
    part = np.zeros(n, dtype=np.int64)
    count = 1
    while count < parts:
        new = part * 2
        for p in range(count):
            mine = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[mine] = np.arange(len(mine))
            inner = (at[rows] >= 0) & (at[cols] >= 0)
            new[mine] += bisect(at[rows[inner]], at[cols[inner]], len(mine), rng)
        part, count = new, count * 2
    return part


@dataclass
class Router:
    """A network of one hidden layer from vectors to parts."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]
    parts: int
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d

    def best(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :probes]


def train(x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, d = (x - mean) / scale, x.shape[1]
    w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            b = order[at : at + 256]
            h = np.maximum(z[b] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), part[b]] -= 1
            p /= len(b)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[b].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                g = g + 1e-4 * w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, w, parts)


def fit(sample: np.ndarray, parts: int, target: float = TARGET) -> Router:
    """A router from a sample; a fifth of it is held out to choose the probes."""
    x = np.unique(sample, axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    k = min(NEIGHBOURS, len(x) - 1)
    if parts < 2 or len(x) < 4 * parts or k < 1:
        d = sample.shape[1]
        return Router(np.zeros(d), np.ones(d), [np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    held = len(x) // 5
    known, asked = x[held:], x[:held]
    router = train(known, balanced_parts(nearest(known, known, k, skip_self=True), parts), parts)
    home, truth = router.best(known, 1)[:, 0], nearest(known, asked, k)
    order = router.best(asked, parts)
    place = (order[:, None, :] == home[truth][:, :, None]).argmax(2)  # probe that finds a neighbour
    found = np.cumsum(np.bincount(place.ravel(), minlength=parts)) / place.size
    router.probes = int(np.searchsorted(found, target)) + 1
    return router


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    # A null component is not finite either; NaN and infinities are caught by their difference from themselves.
    finite = F.forall("v", lambda c: c.isNotNull() & ((c - c) == 0))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def top_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k nearest rows of a block for each query."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order]) + 0.0
    _, first, same = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    rows = np.argsort(same, kind="stable")  # by vector, then id
    begin = np.searchsorted(same[rows], np.arange(len(first) + 1))
    different = x[first]
    norms, out = (different * different).sum(1), []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        far = norms - 2 * part @ different.T
        size = (part * part).sum(1) + norms.max(initial=0)
        # One vector may be the query's own; rounding is allowed for.
        wide = min(k + 1, len(first)) - 1
        limit = np.partition(far, wide, axis=1)[:, wide] + 1e-9 * size
        who, vec = np.nonzero(far <= limit[:, None])
        exact = np.sqrt(((part[who] - different[vec]) ** 2).sum(1))
        # Of equal vectors, the k + 1 smallest ids are enough.
        n = np.minimum(begin[vec + 1] - begin[vec], k + 1)
        each = np.repeat(np.arange(len(who)), n)
        row = rows[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[vec][each]]
        who, exact, found = who[each], exact[each], ids[row]
        other = found != query_ids[at + who]
        who, exact, found = who[other], exact[other], found[other]
        by = np.lexsort((found, exact, who))
        who, exact, found = who[by], exact[by], found[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < k
        out.append((query_ids[at + who[keep]], found[keep], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _blocked(home: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact k nearest of each (query, part), block by block."""
    sizes = [f.groupBy("part").count().withColumnRenamed("count", n) for f, n in ((home, "rows"), (asked, "queries"))]
    # One row for each part, MAX_PARTS at most.
    grid = sizes[0].join(sizes[1], "part").select("part", F.ceil(F.col("rows") / BLOCK_ROWS).alias("nb"), F.ceil(F.col("queries") / BLOCK_ROWS).alias("nq"))
    grid = F.broadcast(grid)
    spread = lambda own, n: F.pmod(F.xxhash64("vec_id", F.lit(own)), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    points = home.join(grid, "part").select("part", spread(1, "nb").alias("b"), copies("nq").alias("q"), "vec_id", "v")
    queries = asked.join(grid, "part").select("part", spread(2, "nq").alias("q"), copies("nb").alias("b"), "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (left.num_rows and right.num_rows):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        left, right = left.combine_chunks(), right.combine_chunks()
        x, q = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
        found = top_of_block(left.column("vec_id").to_numpy(), x, right.column("vec_id").to_numpy(), q, k)
        return pa.table(dict(zip(names, found)))

    key = ["part", "b", "q"]
    return points.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for
    which ``is_query`` (a condition on the id), by Euclidean distance."""
    usable = _usable(vectors, id_col, vec_col)
    lengths = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim, n = (lengths["d"], lengths["count"]) if lengths else (1, 0)
    usable = usable.where(F.size("v") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    x = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((0, dim))
    parts = min(MAX_PARTS, 1 << max(0, int(np.log2(max(n, 1) / part_rows))))
    router = fit(x, parts, target)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.best(_matrix(batch.column("v")), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])

    def route(probes: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    part = router.best(_matrix(batch.column("v")), probes)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), part.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(part.ravel().astype(np.int32))], ["vec_id", "v", "part"])

        return work

    schema = "vec_id long, v array<double>, part int"
    home = staged(usable.mapInArrow(place, schema), "parts")
    queries = usable.where(is_query).dropDuplicates(["vec_id"])

    def ranked(found: DataFrame) -> DataFrame:
        nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)

    out = staged(ranked(_blocked(home, queries.mapInArrow(route(router.probes), schema), k)), "nearest")
    if router.probes < router.parts:
        full = out.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
        short = queries.join(full, queries.vec_id == full.query_id, "left_anti")
        again = ranked(_blocked(home, short.mapInArrow(route(router.parts), schema), k))
        out = out.join(full.select("query_id"), "query_id", "left_semi").select(out.columns).union(again.select(out.columns))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
