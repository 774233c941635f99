"""Small parts of the training-data operators, without Spark."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from satchel.llm import ctw, decontaminate, jaccard_join, learned_partitions, packing, suffix_dedup, toxicity
from satchel.llm.words import Words, blocks, shingle_sets, text_bytes

TEXTS = ["", "one", "One  two\tthree\nfour five SIX", None, "é ü x a", " x ", "a b c d e f g a b c d e"]


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def test_words_and_shingles():
    data, offsets = text_bytes(pa.array(TEXTS))
    words = Words(data, offsets)
    assert words.counts.tolist() == [len(split(t)) for t in TEXTS]
    named = {}
    for text, a, b in zip(TEXTS, words.first[:-1], words.first[1:]):
        for w, h in zip(split(text), words.hashes[a:b]):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)
    sizes = [len(s) for s in shingle_sets(words)]
    want = [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if (w := split(t)) else 0 for t in TEXTS]
    assert sizes == want


def test_blocks_keep_rows_and_offsets():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(TEXTS)], ["id", "t"])
    got = list(blocks([batch.slice(1, 6), batch.slice(0, 0)], "t", limit=8))
    assert [i for b in got for i in b.column(0).to_pylist()] == [1, 2, 3, 4, 5, 6]
    assert [t or "" for b in got for t in ["" if x is None else x for x in b.column(1).to_pylist()]] == [t or "" for t in TEXTS[1:]]
    data, offsets = text_bytes(batch.slice(2, 3).column(1))
    assert bytes(data[offsets[0] : offsets[1]]).decode() == TEXTS[2] and np.diff(offsets).tolist()[1] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=5))
def test_suffix_array_and_copies(texts):
    length = 10
    regions = [(d, 0, np.frombuffer(t.encode(), np.uint8), np.zeros(0, suffix_dedup.TOLD)) for d, t in enumerate(texts) if len(t) >= length]
    if not regions:
        return
    shard = suffix_dedup.Shard(list(regions), length)
    order = suffix_dedup.suffix_array(shard.data, shard.windows, length)
    strings = [bytes(shard.data[i : i + length]) for i in order]
    assert strings == sorted(strings)
    same = suffix_dedup.common_prefixes(shard.data, order, length, stride=4)
    assert same.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]
    seen, want = set(), []
    for d, _, t, _ in regions:
        for i in range(len(t) - length + 1):
            w = bytes(t[i : i + length])
            want.append(w in seen)
            seen.add(w)
    assert shard.copies().tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=6, max_size=12), min_size=1, max_size=4), min_size=1, max_size=5))
def test_merge_shards(shards):
    length, doc, lists, seen, want = 6, 0, [], set(), set()
    for shard in shards:
        ids = list(range(doc, doc + len(shard)))
        doc += len(shard)
        raw = [t.encode() for t in shard]
        lists.append((np.array(ids), np.zeros(len(ids), np.int64), np.array([len(t) - length + 1 for t in raw]), np.frombuffer(b"".join(raw), np.uint8)))
        for d, t in zip(ids, raw):
            for i in range(len(t) - length + 1):
                if t[i : i + length] in seen:
                    want.add((d, i))
                seen.add(t[i : i + length])
    got = {(int(d), int(s) + i) for d, s, n in zip(*suffix_dedup.merge_shards(lists, length)) for i in range(int(n))}
    assert got == want


def test_owned_runs_cover_every_window():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 700).astype(np.uint8)
    offsets = np.array([0, 300, 300, 390, 700])
    text, start, n, place, _ = suffix_dedup.owned_runs(data, offsets, 100, 32)
    got = sorted((int(t), int(s) + i) for t, s, m in zip(text, start, n) for i in range(m))
    assert got == [(t, i) for t in range(4) for i in range(offsets[t + 1] - offsets[t] - 99)]
    assert ((place >= 0) & (place <= 68)).all() and (n <= 69).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=20), st.integers(1, 4))
def test_tiles_are_greedy(a, b, m):
    m = min(m, len(a))
    got = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), m)
    ua, ub, want = [0] * len(a), [0] * len(b), []
    while m and True:
        best, found = m - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= m:
                    found.append((i, j))
        if best < m:
            break
        for i, j in found:
            if not any(ua[i : i + best]) and not any(ub[j : j + best]):
                ua[i : i + best] = ub[j : j + best] = [1] * best
                want.append((i, j, best))
    assert sorted(got) == sorted(want)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(5, 200))
        x = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
        lost = int(len(x) * rng.random() * 0.12)
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[: len(x) - lost]], rng.integers(0, 2**62, int(rng.integers(0, lost + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        common = np.unique(np.concatenate([x, y]))
        df = np.where(np.isin(common, x) & np.isin(common, y), rng.choice([2, 5, 50, 500], len(common)), 1)
        sigs = [jaccard_join.signatures(s, df[np.searchsorted(common, s)], rare=10) for s in (x, y)]
        assert len(np.intersect1d(*sigs)) > 0
        differ = sum(int(w).bit_count() for w in (jaccard_join.parity(x) ^ jaccard_join.parity(y)).view(np.uint64))
        assert differ <= len(x) + len(y) - 2 * both


def test_parity_bitmaps_tell_large_sets_apart():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**62, 1200, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.permutation(len(x))[:900]], rng.integers(0, 2**62, 300, dtype=np.uint64)]))
    differ = sum(int(w).bit_count() for w in (jaccard_join.parity(x) ^ jaccard_join.parity(y)).view(np.uint64))
    assert 9 * differ > len(x) + len(y)  # three fifths alike: not to be compared


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 50, 60).tolist(), reverse=True)
        sources = [None if s == 0 else f"s{s}" for s in rng.integers(0, 6, 60)]
        clusters = rng.integers(0, 40, 60).tolist()
        bins, offsets = packing.best_fit(sizes, sources, clusters, 60)
        left, held = {}, {}
        for size, s, c, b, at in zip(sizes, sources, clusters, bins, offsets):
            fits = {k: r for k, r in left.items() if r >= size and c not in held[k][1] and (s is None or s not in held[k][0])}
            if fits:
                assert left[b] == min(fits.values()) and b in fits
            else:
                assert b not in left
                left[b], held[b] = 60, (set(), set())
            assert at == 60 - left[b]
            left[b] -= size
            held[b][0].add(s)
            held[b][1].add(c)


def test_context_tree_matches_recursion():
    """Chances from tables against a plain recursion over all contexts."""
    text = b"abracadabra abacus"
    depth = ctw.DEPTH
    framed = b"\xff" * depth + text + b"\xff"
    counts = {}
    for i in range(depth, len(framed)):
        for d in range(depth + 1):
            node = 1
            for k in range(7, -1, -1):
                bit = framed[i] >> k & 1
                counts.setdefault((framed[i - d : i], node), [0, 0])[bit] += 1
                node = 2 * node + bit

    def kt_log(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(ctx, node):
        own = kt_log(*counts.get((ctx, node), (0, 0)))
        if len(ctx) == depth:
            return own
        below = sum(weighted(bytes([c]) + ctx, node) for c in range(256) if (bytes([c]) + ctx, node) in counts)
        return np.logaddexp(own, below) - math.log(2)

    def chance(history, node, ctx=b""):
        a, b = counts.get((ctx, node), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if len(ctx) == depth:
            return own
        share = math.exp(kt_log(a, b) - math.log(2) - weighted(ctx, node))
        return share * own + (1 - share) * chance(history, node, history[len(history) - len(ctx) - 1 :])

    keys = np.array([int.from_bytes(framed[i - depth : i + 1], "big") for i in range(depth, len(framed))])
    seen = np.unique(keys & 255)
    rows = []
    pairs = np.unique(keys >> 8 & 65535)
    trees = {p: ctw.Pair(*np.unique(keys[keys >> 8 & 65535 == p], return_counts=True)) for p in pairs}
    for pair, tree in trees.items():
        assert math.isclose(tree.log_p[0], weighted(bytes([pair >> 8, pair & 255]), 1), rel_tol=1e-9)
    # The mixture of a seen context, through the rows of the model.
    def upper(pair):
        last = bytes([pair & 255])

        def mix(below):
            out = np.array(below, dtype=float)
            for node in range(1, 256):
                for ctx in (last, b""):
                    a, b = counts.get((ctx, node), (0, 0))
                    share = math.exp(kt_log(a, b) - math.log(2) - weighted(ctx, node))
                    out[..., node - 1] = share * (b + 0.5) / (a + b + 1) + (1 - share) * out[..., node - 1]
            return out

        return mix

    i = 9
    pair = framed[i - 2] << 8 | framed[i - 1]
    for third, fourth, logs in trees[pair].rows(upper(pair), seen):
        if (third, fourth) == (framed[i - 3], framed[i - 4]):
            rows.append(logs)
    assert len(rows) == 1
    node, total = 1, 0.0
    for k in range(7, -1, -1):
        bit = framed[i] >> k & 1
        p = chance(framed[:i], node)
        total += math.log10(p if bit else 1 - p)
        node = 2 * node + bit
    assert math.isclose(rows[0][list(seen).index(framed[i])], total, rel_tol=1e-5)
    assert math.isclose((10.0 ** rows[0][:-1]).sum() + (256 - len(seen)) * 10.0 ** rows[0][-1], 1, rel_tol=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 8.0, 123.5, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_balanced_parts_are_equal_and_follow_clusters():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16)) * 8
    x = np.concatenate([c + rng.standard_normal((64, 16)) for c in centres])
    part = learned_partitions.balanced_parts(learned_partitions.nearest(x, x, 8, skip_self=True), 8)
    assert np.bincount(part).tolist() == [64] * 8
    assert np.mean([np.bincount(part[k * 64 : k * 64 + 64]).max() for k in range(8)]) > 55


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_of_block_is_exact_with_ties(k):
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (120, 3)).astype(float)
    ids = rng.permutation(120)
    q, query_ids = x[:20], ids[:20]
    got = learned_partitions.top_of_block(ids, x, query_ids, q, k)
    for i in range(20):
        far = np.sqrt(((x - q[i]) ** 2).sum(1))
        want = sorted((d, j) for d, j in zip(far, ids) if j != query_ids[i])[:k]
        mine = got[0] == query_ids[i]
        assert [(d, j) for d, j in zip(got[2][mine], got[1][mine])] == want


def test_linear_fit_and_threshold():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(float)
    col = np.concatenate([np.where(y > 0, 0, 1), rng.integers(2, 30, 400)])
    rows = toxicity.Rows(np.tile(np.arange(400), 2), col, 400, 30, np.zeros((400, 0)))
    w = toxicity.fit_linear(rows, y)
    p = toxicity._sigmoid(rows.dot(w))
    cut = toxicity.best_threshold(p, y)
    assert ((p >= cut) == (y > 0)).all() and w[0] > 0 > w[1]
    assert np.ptp(toxicity._sigmoid(rows.dot(toxicity.fit_linear(rows, np.zeros(400))))) == 0


