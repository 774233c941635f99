"""Language-model scores by context-tree weighting over bytes.

Texts have A-Z lowered and end with an end byte (0xFF, which UTF-8 never
uses). A byte is coded as eight binary decisions. Every decision has one node for
each context length from zero to ``DEPTH`` bytes; a node holds how often the
decision went either way in the training texts and estimates it by the
Krichevsky-Trofimov rule. The weighted probability of a node is half its own
estimate and half the product of the weighted probabilities of its children
(contexts one byte longer), so all depths are mixed, each by how well it
explains the corpus. With the corpus counted, the mixture is a fixed chance
for every byte after every context, and the code length of a text follows.

Counting runs over all training texts as partial counts of (context, byte),
summed by a shuffle. Trees are weighted in one group for each last two bytes
of the context (65,793 contexts at most, worked off in chunks), then for each
last byte (256 groups of 256 rows), then at the root (256 rows). Bytes
that never follow in training share what the trees leave to them equally.
Scoring passes the documents by the model, which travels in blocks of at most
``MODEL_BYTES``, one pass over the documents for each.

The base score uses word counts. Words with at least one in ``FREQUENT`` of
all training words travel to the documents (there can be no more than
``FREQUENT`` of them); the others meet their counts in a shuffle join, after
the words of a document have been summed.

Defined results: a null or empty text is only its end, one token; contexts
before the begin of a text are end bytes. A context never seen leaves the
prediction to the longest one that was. Without training texts every byte has
chance 1/256 and every token 1. Rows that repeat an id are one document whose
sums they share; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.llm.words import Words, blocks, text_bytes
from satchel.session import staged

DEPTH = 4  # longest context in bytes
MODEL_BYTES = 68 << 20  # a block of the model; the contexts of two last bytes fit in
CHUNK = 1_024  # deepest contexts weighted at once
FREQUENT = 4_000_000
FLUSH_KEYS = 2_000_000
END = np.uint8(255)
END_WORD = np.uint64(0x7E57E57E57E57E57)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LN2 = float(np.log(2))


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts lowered, ``DEPTH`` end bytes before, between and after them; where
    each text begins and (behind its end byte) ends."""
    n = len(offsets) - 1
    starts = offsets[:-1] + DEPTH * np.arange(1, n + 1)
    out = np.full(len(data) + DEPTH * (n + 1), END, dtype=np.uint8)
    out[np.arange(len(data)) + DEPTH * np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _LOWER[data]
    return out, starts, starts + np.diff(offsets) + 1


def _coded(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions that are coded: the texts and one end byte each."""
    use = np.zeros(len(at), dtype=bool)
    use[DEPTH:] = True
    for k in range(1, DEPTH):
        use[np.minimum(ends + k - 1, len(at) - 1)] = False
    return use


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling from x + 8)."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= np.where(x < 8, x + k, 1)
    y = np.where(x < 8, x + 8, x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def nodes(counts: np.ndarray) -> np.ndarray:
    """Counts of the 255 binary decisions, (rows, 255, 2), of byte counts."""
    rows = len(counts)
    return np.concatenate([counts.reshape(rows, 1 << k, 2, 128 >> k).sum(3) for k in range(8)], axis=1)


def log_kt(n: np.ndarray) -> np.ndarray:
    a, b = n[..., 0].astype(float), n[..., 1].astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


def kt(n: np.ndarray) -> np.ndarray:
    """Chance of a one."""
    return (n[..., 1] + 0.5) / (n.sum(-1) + 1.0)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimate."""
    both = np.logaddexp(own, below) - _LN2
    return both, np.exp(own - _LN2 - both)


def byte_logs(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log10 chances of the bytes ``seen``, and of any other byte, from those
    of the 255 decisions."""
    out = np.zeros((len(ones), 1))
    for k in range(8):
        p = ones[:, (1 << k) - 1 : (2 << k) - 1]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], axis=2).reshape(len(ones), -1)
    rest = np.setdiff1d(np.arange(256), seen)
    other = np.log10(np.maximum((10 ** out[:, rest]).sum(1), 1e-300) / max(len(rest), 1))
    return np.column_stack([out[:, seen], other]).astype(np.float32)


def mixed(weight: np.ndarray, own: np.ndarray, below: np.ndarray | float) -> np.ndarray:
    return weight * own + (1 - weight) * below


class Pair:
    """The contexts that end in the same two bytes. ``key`` holds (4th, 3rd,
    2nd, last byte of the context, coded byte), eight bits each."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = key[order].astype(np.int64), n[order]
        self.counts, below = np.zeros(256, dtype=np.int64), np.zeros(255)
        for third, cut, deep in self._chunks():
            three = np.add.reduceat(deep, cut, axis=0)
            log_p, _ = weighted(log_kt(nodes(three)), np.add.reduceat(log_kt(nodes(deep)), cut, axis=0))
            self.counts += three.sum(0)
            below += log_p.sum(0)
        self.one = kt(nodes(self.counts[None]))[0]
        self.log_p, self.weight = weighted(log_kt(nodes(self.counts[None]))[0], below)

    def _chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some three-byte contexts at a time: their third bytes, where each
        begins among the four-byte contexts, and the byte counts of those."""
        deepest, first = np.unique(self.key >> 24, return_index=True)
        ends = np.append(first[1:], len(self.key))
        by = np.lexsort((deepest, deepest & 255))
        third = (deepest & 255)[by]
        heads = np.flatnonzero(np.append(True, third[1:] != third[:-1]))
        at = 0
        while at < len(heads):
            to = max(at + 1, int(np.searchsorted(heads, heads[at] + CHUNK, "right")) - 1)
            to = len(heads) if len(by) <= heads[at] + CHUNK else to
            stop = heads[to] if to < len(heads) else len(by)
            some = by[heads[at] : stop]
            size = ends[some] - first[some]
            source = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[some], size)
            deep = np.zeros((len(some), 256), dtype=np.int64)
            deep[np.repeat(np.arange(len(some)), size), self.key[source] & 255] = self.n[source]
            self.fourth = deepest[some] >> 8
            yield third[heads[at:to]], heads[at:to] - heads[at], deep
            at = to

    def rows(self, upper, seen: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(third, fourth, log10 chances); -1 stands for every byte not seen.
        ``upper`` mixes in the shorter contexts."""
        yield -1, -1, byte_logs(upper(mixed(self.weight, self.one, 0.5))[None], seen)[0]
        for third, cut, deep in self._chunks():
            three = np.add.reduceat(deep, cut, axis=0)
            _, weight = weighted(log_kt(nodes(three)), np.add.reduceat(log_kt(nodes(deep)), cut, axis=0))
            own = kt(nodes(three))
            for t, logs in zip(third.tolist(), byte_logs(upper(mixed(self.weight, self.one, mixed(weight, own, 0.5))), seen)):
                yield t, -1, logs
            at = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(deep))))
            ones = upper(mixed(self.weight, self.one, mixed(weight[at], own[at], kt(nodes(deep)))))
            yield from zip(third[at].tolist(), self.fourth.tolist(), byte_logs(ones, seen))


def _count(training: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts (context, byte), kind 1 words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def flush(kind):
            if held[kind]:
                keys, at = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in held[kind]])).astype(np.int64)
                held[kind] = [(keys, n)]

        def rows(kind):
            flush(kind)
            for keys, n in held[kind]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n)], ["kind", "key", "n"])
            held[kind] = []

        for block in blocks(batches, "_text"):
            data, offsets = text_bytes(block.column("_text"))
            text, starts, ends = framed(data, offsets)
            wide = text.astype(np.uint64)
            grams = wide.copy()
            for k in range(1, DEPTH + 1):
                grams[k:] |= wide[:-k] << np.uint64(8 * k)
            held[0].append(np.unique(grams[_coded(grams, starts, ends)], return_counts=True))
            words = np.append(Words(data, offsets).hashes, np.full(block.num_rows, END_WORD))
            held[1].append(np.unique(words, return_counts=True))
            for kind in (0, 1):
                if sum(len(k) for k, _ in held[kind]) > FLUSH_KEYS:
                    flush(kind)
                    if len(held[kind][0][0]) > FLUSH_KEYS // 2:
                        yield from rows(kind)
        yield from rows(0)
        yield from rows(1)

    return training.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _model(grams: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(pair, third, fourth, logs) of every context seen, for each last byte
    the chances after a pair that was not seen, and the bytes that were coded."""
    seen = np.array(sorted(r[0] for r in grams.select(F.col("key").bitwiseAND(255)).distinct().collect()), dtype=np.int64)
    by_pair = grams.select(F.shiftright("key", 8).bitwiseAND(65535).alias("pair"), "key", "n")

    def pair_top(rows: pd.DataFrame) -> pd.DataFrame:
        tree = Pair(rows.key.to_numpy(), rows.n.to_numpy())
        return pd.DataFrame({"last": [int(rows.pair.iloc[0]) & 255], "counts": [tree.counts.tobytes()], "log_p": [tree.log_p.tobytes()]})

    def last_top(rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
        log_p, weight = weighted(log_kt(nodes(counts[None]))[0], sum(np.frombuffer(p) for p in rows.log_p))
        return pd.DataFrame({"last": [int(rows["last"].iloc[0])], "counts": [counts.tobytes()], "log_p": [log_p.tobytes()], "weight": [weight.tobytes()]})

    pairs = by_pair.groupBy("pair").applyInPandas(pair_top, "last int, counts binary, log_p binary")
    tops = pairs.groupBy("last").applyInPandas(last_top, "last int, counts binary, log_p binary, weight binary").collect()  # 256 rows at most
    counts = sum((np.frombuffer(r["counts"], np.int64) for r in tops), np.zeros(256, dtype=np.int64))
    below = sum((np.frombuffer(r["log_p"]) for r in tops), np.zeros(255))
    root = kt(nodes(counts[None]))[0]
    _, top = weighted(log_kt(nodes(counts[None]))[0], below)
    weight, own = np.zeros((256, 255)), np.full((256, 255), 0.5)
    for r in tops:
        weight[r["last"]] = np.frombuffer(r["weight"])
        own[r["last"]] = kt(nodes(np.frombuffer(r["counts"], np.int64)[None]))[0]
    rest = byte_logs(mixed(top, root, mixed(weight, own, 0.5)), seen)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        pair = int(rows.pair.iloc[0])
        last = pair & 255
        found = Pair(rows.key.to_numpy(), rows.n.to_numpy()).rows(lambda below: mixed(top, root, mixed(weight[last], own[last], below)), seen)
        return pd.DataFrame([(pair, t, f, logs.tobytes()) for t, f, logs in found], columns=["pair", "third", "fourth", "logs"])

    return staged(by_pair.groupBy("pair").applyInPandas(finish, "pair int, third int, fourth int, logs binary"), "ctw"), rest, seen


class Table:
    """A block of the model: all contexts that end in some pairs of bytes."""

    def __init__(self, rows: pa.Table, rest: np.ndarray, seen: np.ndarray, unseen: np.ndarray):
        pair, third, fourth = (rows.column(c).to_numpy().astype(np.int64) for c in ("pair", "third", "fourth"))
        logs = np.frombuffer(b"".join(rows.column("logs").to_pylist()), np.float32).reshape(len(pair), rest.shape[1])
        width = self.width = rest.shape[1]
        self.column = np.full(256, width - 1, dtype=np.int32)  # the last column is any byte not seen
        self.column[seen] = np.arange(len(seen))
        # Row 0 is what another block scores, 1 to 256 are pairs not seen.
        self.logs = np.concatenate([np.zeros((1, width), np.float32), rest, logs])
        at = np.arange(len(pair), dtype=np.int32) + 257
        pairs, here = np.unique(pair, return_inverse=True)
        two, three, four = third < 0, (third >= 0) & (fourth < 0), fourth >= 0
        third, fourth = self.column[third], self.column[fourth]
        triples = np.unique(here[~two] * width + third[~two])
        # Byte by byte: a pair has a line of thirds, a triple a line of fourths.
        self.of_pair = np.zeros(65536, dtype=np.int32)
        self.of_pair[unseen] = 1 + (unseen & 255)
        self.of_pair[pairs] = 257 + np.arange(len(pairs))
        self.of_third = np.repeat(np.arange(257 + len(pairs), dtype=np.int32)[:, None], width, axis=1)
        self.of_third[257 + triples // width, triples % width] = 257 + len(pairs) + np.arange(len(triples))
        self.of_fourth = np.zeros((257 + len(pairs) + len(triples), width), dtype=np.int32)
        self.of_fourth[:257] = np.arange(257)[:, None]
        self.of_fourth[257 + here[two]] = at[two][:, None]
        self.of_fourth[self.of_third[257 + here[three], third[three]]] = at[three][:, None]
        self.of_fourth[self.of_third[257 + here[four], third[four]], fourth[four]] = at[four]

    def score(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 chance of each text."""
        column = self.column[text]
        line = self.of_pair[text[2:-2].astype(np.int32) * 256 + text[3:-1]]
        line = self.of_third.ravel()[line * self.width + column[1:-3]]
        row = self.of_fourth.ravel()[line * self.width + column[:-4]]
        logs = np.zeros(len(text) + 1)
        logs[4:-1] = self.logs.ravel()[row * self.width + column[4:]]
        return np.add.reduceat(logs, np.column_stack([starts, ends]).ravel())[::2]


def _blocks_of(model: DataFrame, width: int) -> list[list[int]]:
    """Pairs of bytes dealt into blocks of at most MODEL_BYTES."""
    most = MODEL_BYTES // (4 * width)
    out, room = [[]], most
    for r in sorted(model.groupBy("pair").count().collect()):  # 65,536 rows at most
        if r["count"] > room and out[-1]:
            out, room = [*out, []], most
        out[-1].append(r["pair"])
        room -= r["count"]
    return out


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte) of every document; ``training`` holds the texts learnt from.
    n_bytes and bits_per_byte count the end byte."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    counts = staged(_count(training.select(F.col(text_col).alias("_text"))), "counts")
    words = counts.where("kind = 1").select(F.col("key").alias("word"), "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_words = int(total["n"]), int(total["v"])
    least = n_train / FREQUENT
    often = words.where(F.col("n") >= least).toArrow()
    order = np.argsort(keys := often.column("word").to_numpy().view(np.uint64))
    frequent = keys[order], often.column("n").to_numpy()[order]
    model, rest, coded = _model(counts.where("kind = 0").select("key", "n"))
    seen = _blocks_of(model, rest.shape[1])
    names = ["doc_id", "n_bytes", "n_tokens", "n_known", "known_log", "score", "rare", "times"]
    schema = "doc_id long, n_bytes long, n_tokens long, n_known long, known_log double, score double, rare array<long>, times array<int>"
    unseen = np.setdiff1d(np.arange(65536), [p for part in seen for p in part])

    def one_pass(part: int) -> DataFrame:
        rows = model.where(F.col("pair").between(min(seen[part], default=0), max(seen[part], default=0))).toArrow()
        sent = spark.sparkContext.broadcast((Table(rows, rest, coded, unseen[: 0 if part else None]), frequent if not part else None))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, common = sent.value
            for block in blocks(batches, "_text"):
                data, offsets = text_bytes(block.column("_text"))
                size, n = block.num_rows, np.zeros(block.num_rows, dtype=np.int64)
                columns = [n, n, n, np.zeros(size)]
                rare = pa.ListArray.from_arrays(pa.array(np.zeros(size + 1, np.int32)), pa.array([], pa.int64()))
                times = rare.cast(pa.list_(pa.int32()))
                if common is not None:
                    columns, rare, times = _base(data, offsets, *common)
                text, starts, ends = framed(data, offsets)
                logs = pa.array(table.score(text, starts, ends))
                yield pa.RecordBatch.from_arrays([block.column("_id"), *[pa.array(c) for c in columns], logs, rare, times], names)

        out = staged(docs.mapInArrow(work, schema), "scored")
        sent.destroy()  # written; the next block takes its place
        return out

    scored = one_pass(0)
    for part in range(1, len(seen)):
        scored = scored.union(one_pass(part))
    rare = scored.select("doc_id", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("doc_id", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(words.where(F.col("n") < least).hint("merge"), "word", "left")
    met = met.groupBy("doc_id").agg(
        F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("known_log"), F.lit(0.0).alias("score"),
    )
    sums = ["n_bytes", "n_tokens", "n_known", "known_log", "score"]
    out = scored.select("doc_id", *sums).union(met.select("doc_id", *sums)).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in sums])
    floor = float(np.log10(n_train + n_words + 1))
    return out.select(
        "doc_id", "n_bytes", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * floor).alias("base_score"), "score",
        (-F.col("score") / (F.col("n_bytes") * float(np.log10(2)))).alias("bits_per_byte"),
    )


def _base(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, n: np.ndarray):
    """Token sums over frequent words; the other words, each once with its count."""
    words = Words(data, offsets)
    size = len(offsets) - 1
    doc = np.append(words.doc, np.arange(size))
    hashes = np.append(words.hashes, np.full(size, END_WORD))
    at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), dtype=bool)
    logs = np.bincount(doc[known], np.log10(n[at[known]] + 1.0), size).astype(float)
    d, h = doc[~known], hashes[~known]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(d))).astype(np.int32)
    cut = pa.array(np.searchsorted(d[first], np.arange(size + 1)).astype(np.int32))
    columns = [np.diff(offsets) + 1, np.bincount(doc, minlength=size), np.bincount(doc[known], minlength=size), logs]
    return columns, pa.ListArray.from_arrays(cut, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times))
