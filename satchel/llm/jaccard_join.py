"""Near duplicates by an exact n-gram Jaccard join with token combinations.

A document is the set of its five-word shingles (tokens). Two sets with
Jaccard similarity of at least 4/5 miss at most a fifth of each other, so in
any common order of tokens the first ``n - ceil(4n/5) + k`` of both hold at
least ``k`` common ones. Used twice:

1. In the order of the hash values, each document publishes such a prefix. A
   document of which too few published tokens are published elsewhere has no
   partner and leaves.
2. For those that stay, the number of documents of every token is counted and
   prefixes are taken rarest token first, extended by ``k = n // 10 + 1``. A
   rare token is indexed by itself. Frequent tokens are dealt into fewer
   classes than ``k``; if two prefixes share no rare token, some class holds
   two of the shared ones, so pairs of frequent tokens of one class are
   indexed, and a token that half the corpus holds never makes a list of its own.

Documents with equal sets are one representative, and index lists with equal
members one list. Lists are linked to a
pivot each, then to the pivots of components not yet connected, and only what
still lies in different components is compared pair by pair, if counts and
parity bitmaps leave it possible; every link that
could join two components is verified on the sets, so components are exact.

Defined results: a null or empty text has an empty set and is its own
component; with fewer than five words the whole sequence is the one shingle;
rows without an id are left out; of rows that repeat an id, the one with the
largest set stands for it. Other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.graphs import components
from satchel.llm.words import Words, blocks, mix, shingle_sets, text_bytes
from satchel.session import broadcast_if_small, staged

RARE = 32  # documents a token may occur in and still be indexed by itself
LEAST = 4  # tokens of the smallest set that a different one can be similar to: 4 of 5
BLOCK_TOKENS = 1_000_000
BLOCK_DOCS = 60_000
NOBODY = 65_535
STAR_ROUNDS = 3
BITS = 2048  # of a parity bitmap; with few, large sets that are far apart look alike


def _extension(n: int) -> int:
    return n // 10 + 1


def _needed(n: int) -> int:
    """Fewest tokens a partner must share: ceil(4n/5)."""
    return (4 * n + 4) // 5


def _prefix(n: int) -> int:
    return min(n, n - _needed(n) + _extension(n))


def _levels() -> list[int]:
    """Bounds of size levels: partners lie in the same or in adjacent levels."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 5 // 4 + 1)
    return out


LEVELS = _levels()


def _pack(values, kind) -> bytes:
    return np.asarray(values, dtype=kind).tobytes()


def _published(docs: DataFrame, buckets: int) -> DataFrame:
    """Messages to buckets of tokens: per block of documents the hash-order
    prefixes, each token once, with the document that holds it, or NOBODY if
    several of the block do (those are credited at once)."""

    def block_rows(ids, sets):
        n = np.array([len(s) for s in sets])
        digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
        heads = [s[: _prefix(len(s))] if len(s) >= LEAST else s[:0] for s in sets]
        who = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
        tokens = np.concatenate([np.zeros(0, np.uint64), *heads])
        order = np.argsort(tokens)
        tokens, who = tokens[order], who[order]
        fresh = np.ones(len(tokens), dtype=bool)
        fresh[1:] = tokens[1:] != tokens[:-1]
        at = np.flatnonzero(fresh)
        several = np.diff(np.append(at, len(tokens))) > 1
        shared = np.repeat(several, np.diff(np.append(at, len(tokens))))
        credit = np.bincount(who[shared], minlength=len(sets))
        tokens, holder = tokens[at], np.where(several, NOBODY, who[at])
        to = (mix(tokens) % np.uint64(buckets)).astype(np.int64)
        yield "", int(ids[0] % buckets), _pack(ids, "i8"), _pack(n, "i4"), digests, b"", b""
        who = np.flatnonzero(credit)
        yield "", int(ids[0] % buckets), b"", b"", b"", b"", _pack(np.column_stack([who, credit[who]]), "i4")
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(buckets + 1))
        for b in range(buckets):
            part = by[cut[b] : cut[b + 1]]
            if len(part):
                yield "", b, b"", b"", b"", tokens[part].tobytes(), _pack(holder[part], "u2")

    names = ["block", "bucket", "ids", "n", "digests", "tokens", "held"]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            # Named by place and content: what is told of a block goes to that block.
            name = f"{TaskContext.get().partitionId()}-{hashlib.blake2b(_pack(ids, 'i8'), digest_size=8).hexdigest()}"
            for _, *row in block_rows(np.array(ids, dtype=np.int64), sets):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, *row), kinds)], names)

        ids, sets, size = [], [], 0
        for block in blocks(batches, "_text"):
            data, offsets = text_bytes(block.column("_text"))
            for i, s in zip(block.column("_id").to_pylist(), shingle_sets(Words(data, offsets))):
                ids.append(i)
                sets.append(s)
                size += len(s)
            if size >= BLOCK_TOKENS or len(ids) > BLOCK_DOCS - 20_000:
                yield from flush()
                ids, sets, size = [], [], 0
        if ids:
            yield from flush()

    return docs.mapInArrow(publish, "block string, bucket int, " + ", ".join(f"{n} binary" for n in names[2:]))


def _facts(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest, seen): size and digest of each set, and how many of
    its published tokens other documents publish too."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """Tells each block which of its documents' tokens are published
        elsewhere; other messages pass through."""
        sent = rows.tokens.str.len() > 0
        out, asked = rows[~sent][["block", "ids", "n", "digests", "held"]], rows[sent]
        if not len(asked):
            return out
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in asked.tokens])
        cut = np.cumsum([0, *(len(t) // 8 for t in asked.tokens)])
        order = np.argsort(tokens)
        same = tokens[order][1:] == tokens[order][:-1]
        common = np.zeros(len(tokens), dtype=bool)
        common[order[1:][same]] = common[order[:-1][same]] = True
        told = []
        for a, b, holder in zip(cut[:-1], cut[1:], asked.held):
            here = np.frombuffer(holder, "u2")[common[a:b]]
            credit = np.bincount(here[here != NOBODY])
            who = np.flatnonzero(credit)
            told.append(_pack(np.column_stack([who, credit[who]]), "i4"))
        return pd.concat([out, pd.DataFrame({"block": asked.block, "ids": b"", "n": b"", "digests": b"", "held": told})])

    def credit(rows: pd.DataFrame) -> pd.DataFrame:
        """Facts of a block's documents, all credits summed."""
        head = next(r for r in rows.itertuples() if r.ids)
        ids = np.frombuffer(head.ids, "i8")
        seen = np.zeros(len(ids), dtype=np.int64)
        for held in rows.held:
            who, times = np.frombuffer(held, "i4").reshape(-1, 2).T
            seen[who] += times
        digests = [head.digests[i : i + 16] for i in range(0, len(head.digests), 16)]
        return pd.DataFrame({"doc_id": ids, "n": np.frombuffer(head.n, "i4"), "digest": digests, "seen": seen})

    told = _published(docs, buckets).groupBy("bucket").applyInPandas(meet, "block string, ids binary, n binary, digests binary, held binary")
    facts = told.groupBy("block").applyInPandas(credit, "doc_id long, n int, digest binary, seen long")
    # Of rows that repeat an id, the largest set stands for it.
    facts = facts.groupBy("doc_id").agg(F.max(F.struct("n", "digest")).alias("top"), F.sum("seen").alias("seen"))
    return facts.select("doc_id", "top.n", "top.digest", "seen")


def _set_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(block, ids, sizes, tokens): the whole sets of the wanted documents."""
    some = docs.join(broadcast_if_small(wanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))), "_id")
    names = ["block", "ids", "sizes", "tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sets = 0, [], []

        def flush():
            row = (f"{TaskContext.get().partitionId()}-{number}", _pack(ids, "i8"), _pack([len(s) for s in sets], "i4"), b"".join(s.tobytes() for s in sets))
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *[pa.array([v], pa.binary()) for v in row[1:]]], names)

        for block in blocks(batches, "_text"):
            data, offsets = text_bytes(block.column("_text"))
            for i, d, s in zip(block.column("_id").to_pylist(), block.column("_digest").to_pylist(), shingle_sets(Words(data, offsets))):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d:
                    ids.append(i)
                    sets.append(s)
            if sum(map(len, sets)) >= BLOCK_TOKENS:
                yield flush()
                number, ids, sets = number + 1, [], []
        if ids:
            yield flush()

    return staged(some.select("_id", "_digest", "_text").mapInArrow(pack, "block string, ids binary, sizes binary, tokens binary"), "set-blocks")


def _frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, df): for the sorted distinct tokens of a block that fall
    into a bucket, the number of documents they occur in."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist()):
                values, counts = np.unique(np.frombuffer(tokens, np.uint64), return_counts=True)
                to = (mix(values) % np.uint64(buckets)).astype(np.int64)
                rows = [(b, values[m].tobytes(), _pack(counts[m], "u4")) for b in range(buckets) if (m := to == b).any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    ["bucket", "block", "tokens", "counts"],
                )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in rows.tokens])
        counts = np.concatenate([np.frombuffer(c, "u4") for c in rows["counts"]]).astype(np.int64)
        _, at = np.unique(tokens, return_inverse=True)
        df = np.minimum(np.bincount(at, counts), 2**31).astype("u4")[at]
        cut = np.cumsum([0, *(len(t) // 8 for t in rows.tokens)])
        return pd.DataFrame({"block": rows.block, "bucket": rows.bucket, "df": [df[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]})

    asked = sets.select("block", "tokens").mapInArrow(ask, "bucket int, block string, tokens binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block string, bucket int, df binary")


def signatures(tokens: np.ndarray, df: np.ndarray, rare: int = RARE) -> np.ndarray:
    """Index entries of one set."""
    n = len(tokens)
    if (df > 1).sum() < _needed(n):
        return tokens[:0]  # too much of it occurs nowhere else
    head = np.lexsort((tokens, df))[: _prefix(n)]
    head = head[df[head] > 1]
    common = tokens[head[df[head] > rare]]
    out = [mix(tokens[head[df[head] <= rare]] ^ np.uint64(0x51))]
    own = int(np.searchsorted(LEVELS, n, "right")) - 1
    for level in (own, own + 1) if len(common) else ():
        salt = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        classes = _extension(_needed(LEVELS[level])) - 1
        if not classes:
            out.append(mix(common ^ salt))
            continue
        kind = (mix(common + np.uint64(1)) % np.uint64(classes)).astype(np.int64)
        order = np.lexsort((common, kind))
        ordered, cut = common[order], np.searchsorted(kind[order], np.arange(classes + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                out.append(mix(mix(ordered[a:b][i] ^ salt) + ordered[a:b][j]))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray) -> np.ndarray:
    """For each of BITS classes of tokens, whether their number is odd. Where
    the bitmaps of two sets differ, the sets do: they differ in at least as
    many tokens as bits."""
    odd = np.bincount((mix(tokens + np.uint64(7)) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(sets: DataFrame, rare: int) -> DataFrame:
    """(doc_id, n, m, sigs, bits, tokens): index entries of each document, its
    parity bitmap, and those ``m`` of its tokens that occur elsewhere."""
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sign(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            tokens = np.frombuffer(r.tokens, np.uint64)
            values, at = np.unique(tokens, return_inverse=True)
            df, to = np.ones(len(values), dtype=np.int64), (mix(values) % np.uint64(buckets)).astype(np.int64)
            for a in answers.itertuples():
                df[to == a.bucket] = np.frombuffer(a.df, "u4")
            df, end = df[at], 0
            for i, n in zip(np.frombuffer(r.ids, "i8"), np.frombuffer(r.sizes, "i4")):
                begin, end = end, end + int(n)
                sigs = signatures(tokens[begin:end], df[begin:end], rare)
                if len(sigs):
                    shared = tokens[begin:end][df[begin:end] > 1]
                    out.append((int(i), int(n), len(shared), sigs.view(np.int64), parity(tokens[begin:end]), shared.tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "n", "m", "sigs", "bits", "tokens"])

    answers = _frequencies(sets, buckets)
    return sets.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(sign, "doc_id long, n int, m int, sigs array<long>, bits array<long>, tokens binary")


def _lists(index: DataFrame) -> DataFrame:
    """(sig, weight): of index lists of several documents one for each set of
    members, and how many have that set. Near copies share hundreds of lists,
    most of them by themselves; members are told apart by 128 bits."""
    lists = index.groupBy("sig").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("doc_id")).alias("_x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("_y")
    )
    return lists.where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("sig").alias("sig"), F.count("*").alias("weight")).select("sig", "weight")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            both = np.array([
                len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                for x, y in zip(batch.column("ta"), batch.column("tb"))
            ], dtype=np.int64)
            ok = pa.array(100 * both >= 80 * (na.astype(np.int64) + nb - both))
            yield batch.select(["a", "b"]).filter(ok)

    return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(compare, "a long, b long")


def _possible(na: str, ma: str, nb: str, mb: str) -> Column:
    """Whether two sets can be similar enough, as no more is shared than the
    tokens of either that occur elsewhere: 100 i >= 80 (na + nb - i)."""
    return 9 * F.least(ma, mb) >= 4 * (F.col(na) + F.col(nb))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): size of the set, smallest
    id reachable by links, and how many links were found at the document on
    the way to it (exact copies excluded)."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    facts = staged(_facts(docs), "facts")
    reps = staged(facts.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("seen").alias("seen")), "reps")
    # A partner of four fifths of the size publishes at least so many in common.
    least = F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10) + 1
    hopeful = reps.where((F.col("n") >= LEAST) & (F.col("seen") >= least)).select(F.col("rep").alias("doc_id"), "digest")
    sets = staged(_signed(_set_blocks(docs, hopeful), rare), "signed")
    index = sets.select(F.explode("sigs").alias("sig"), "doc_id", "n", "m").distinct()
    index = staged(index.join(_lists(index), "sig"), "index")

    links, tried, comp = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        live = index.withColumn("component", F.col("doc_id"))
        if comp is not None:
            live = index.join(comp, index.doc_id == comp.v, "left").drop("v").withColumn("component", F.coalesce("component", "doc_id"))
        mixed = live.groupBy("sig").agg(F.min("component").alias("_low"), F.max("component").alias("_top")).where("_low < _top")
        if turn < STAR_ROUNDS:
            # Each document meets the pivot, out of its lists' smallest component, that it shares most lists with.
            pivots = live.groupBy("sig").agg(F.min(F.struct("component", "doc_id", "n", "m")).alias("p"), F.max("component").alias("_top"))
            met = live.join(pivots.where("p.component < _top"), "sig").where("component <> p.component").where(_possible("n", "m", "p.n", "p.m"))
            met = met.groupBy(F.col("doc_id").alias("b"), F.col("p.doc_id").alias("a")).agg(F.sum("weight").alias("_n"))
            # A document's pivots are one row, as many as it has lists at most.
            best = met.groupBy("b").agg(F.collect_list(F.struct("_n", F.negative("a").alias("_a"))).alias("_all"))
            if tried is not None:
                seen = tried.groupBy("b").agg(F.collect_set(F.negative("a")).alias("_seen"))
                best = best.join(seen, "b", "left").withColumn("_all", F.filter("_all", lambda x: ~F.coalesce(F.array_contains("_seen", x["_a"]), F.lit(False))))
            pairs = best.where(F.size("_all") > 0).select(F.negative(F.array_max("_all")["_a"]).alias("a"), "b")
        else:
            # What is left in different components is compared pair by pair.
            words = range(BITS // 64)
            rest = live.join(mixed.select("sig"), "sig").join(sets.select("doc_id", *[F.col("bits")[w].alias(f"w{w}") for w in words]), "doc_id")
            side = lambda x: rest.select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "m", "component", *[f"w{w}" for w in words])])
            differ = sum((F.bit_count(F.col(f"w{w}_a").bitwiseXOR(F.col(f"w{w}_b"))) for w in words), F.lit(0))
            # One side of a pair lies outside the list's largest component.
            sizes = rest.groupBy("sig", "component").agg(F.count("*").alias("_n"))
            main = sizes.groupBy("sig").agg(F.max_by("component", F.struct("_n", "component")).alias("_main"))
            outside = side("a").join(main, "sig").where("component_a <> _main").drop("_main")
            pairs = outside.join(side("b"), "sig").where(
                (F.col("component_a") != F.col("component_b")) & _possible("n_a", "m_a", "n_b", "m_b") & (9 * differ <= F.col("n_a") + F.col("n_b"))
            )
            pairs = pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"))
            both = tried.union(tried.select("b", "a"))
            # Distinct ones that were not tried, by one aggregate: a pair is found in many lists.
            found = pairs.withColumn("_new", F.lit(True)).union(both.withColumn("_new", F.lit(False)))
            pairs = found.groupBy("a", "b").agg(F.bool_and("_new").alias("_new")).where("_new").drop("_new")
        pairs = staged(pairs, "pairs")
        new = staged(_verified(pairs, sets), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = new if links is None else links.union(new)
        comp = staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("_links"))
    classes = reps.join(comp, reps.rep == comp.v, "left").join(degree, "rep", "left")
    classes = classes.select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("_component"), F.coalesce("_links", F.lit(0)).alias("_links"))
    both = facts.join(classes, (facts.digest == F.col("_digest")) & (facts.n > 0), "left")
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
    )
