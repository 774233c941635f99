"""The training-data operators on small tables of awkward rows, against brute force."""

import hashlib
import math
import re
import sys
import textwrap
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from satchel.llm import ctw, decontaminate, jaccard_join, learned_partitions, licences, line_dedup, packing, suffix_dedup, toxicity, warc  # noqa: E402
from satchel.llm.graphs import components  # noqa: E402
from satchel.session import scratch_path  # noqa: E402

RNG = np.random.default_rng(12)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyzé"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def awkward_texts():
    base, passage, long = prose(120), prose(60), prose(6_000)
    edited = base.split()
    for i in range(10, 100, 30):
        edited[i] = "edited"
    lines = "\n".join(prose(12) for _ in range(6))
    return [
        None, "", " \n ", "one", "two words", "two  WORDS", base, base, base.upper(), " ".join(edited), f"{prose(40)} {passage} {prose(50)}",
        f"{passage} {prose(70)}", f"{lines}\n{prose(20)}", f"{prose(9)}\n{lines}", "x" * 400, "x" * 250, long, f"{long[:9000]} {prose(30)}",
        "a\n\n\n\nb", prose(300), "same line\n" * 12, "\x00" * 120 + "end", passage + "\n" + passage, "one",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, "en", "src0" if i % 2 else None, i, "clash", "clash", 1) for i, t in enumerate(awkward_texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _doc string, component_id string, n_lines int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]


def test_suffix_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in plain(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want[i] = (len(b), spans, bytes(x for x, g in zip(b, gone) if not g))
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got == want and sum(len(v[1]) for v in want.values()) > 5
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_suffix_dedup_in_small_shards(docs, monkeypatch):
    whole = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(docs).collect()}
    for name, value in (("SHARD_BYTES", 500), ("BLOCK_GRAMS", 20), ("HOT", 1), ("PIECE_BYTES", 1_000), ("SHARD_RUNS", 1)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(sys.modules["satchel.llm.words"], "BLOCK_BYTES", 800)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_substrings(docs).collect()} == whole
    twice = suffix_dedup.dedup_substrings(docs.union(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("kept").alias("k")).collect()
    assert all(r.n == 2 and [bytes(k) for k in r.k] == [whole[r.doc_id]] for r in twice)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(docs, empty, monkeypatch):
    sets = {i: shingles(t) for i, t in plain(docs)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in want.values()}) < len(want) - 2
    for rare in (32, 1):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, rare=rare).collect()}
        assert got == want
    assert jaccard_join.near_duplicates(empty).count() == 0
    again = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(again).collect()} == want


def test_jaccard_join_of_many_near_copies(spark):
    base = prose(150).split()
    rows = []
    for i in range(150):
        words = list(base)
        for at in RNG.choice(150, RNG.integers(0, 6), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    reach = {i: i for i in sets}
    for _ in range(8):
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * len(sets[i] | sets[j]):
                    reach[i] = reach[j] = min(reach[i], reach[j])
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rare=4).collect()}
    assert got == reach


def test_jaccard_join_takes_lists_of_equal_members_once(spark):
    members = {1: (1, 2), 2: (1, 2), 3: (2, 1), 4: (1, 2, 3), 5: (3,), 6: (2, 3), 7: (4, 5), 8: (4, 5)}
    index = spark.createDataFrame([(sig, d, 9, 9) for sig, docs in members.items() for d in docs], "sig long, doc_id long, n int, m int")
    lists = {r.sig: r.weight for r in jaccard_join._lists(index).collect()}
    assert lists == {1: 3, 4: 1, 6: 1, 7: 2}


def test_jaccard_join_of_small_sets(spark):
    """Sets of 4 lie inside sets of 5: windows of 8 words and the same with a word before or after."""
    rng = np.random.default_rng(5)
    w = [f"v{i}" for i in range(400)]
    texts = [w[:8], ["before", *w[:8]], [*w[:8], "after"], w[20:28], w[20:29], w[21:29], w[40:47], w[40:48], w[60:68], w[61:69], w[20:28]]
    for n in range(5, 13):  # chains that hang on a set of 4, and sizes around it
        at = 90 + 14 * n
        texts += [w[at : at + n], w[at : at + n + 1], ["x", *w[at : at + n]]]
    texts += [[*w[360:368], f"end{i}"] for i in range(40)] + [w[360:368]]  # the four are frequent tokens
    texts += [list(rng.choice(w[390:392], int(rng.integers(7, 12)))) for _ in range(60)]
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {(len(sets[i]), len(sets[j])) for i, j in links} >= {(4, 5), (5, 6)}
    want, before = {i: i for i in sets}, None
    while want != before:
        before = dict(want)
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rare in (32, 1):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(table, rare=rare).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 150), (101, 100)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 150, 150: 150}


def test_line_dedup(docs, empty):
    texts = {r.doc_id: r.text for r in docs.collect()}
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        lines = texts[i].split("\n") if texts[i] is not None else []
        runs = set()
        for a in range(len(lines)):
            for sign in (1, -1):
                for n in range(1, 9):
                    lo = a if sign > 0 else a - n + 1
                    if lo < 0 or lo + n > len(lines):
                        break
                    if n == 8 or sum(len(x) + 1 for x in lines[lo : lo + n]) >= line_dedup.MIN_CHARS:
                        runs.add((lo, n))
                        break
        for lo, n in sorted(runs):
            key = (n, tuple(lines[lo : lo + n]))
            if first.setdefault(key, (i, lo)) != (i, lo):
                gone[i] |= set(range(lo, lo + n))
    done = line_dedup.dedup_lines(docs)
    assert set(done.columns) == {*docs.columns, "n_deleted"}
    for r in done.collect():
        lines = texts[r.doc_id].split("\n") if texts[r.doc_id] is not None else []
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone[r.doc_id]) if texts[r.doc_id] is not None else None
        assert (r.n_lines, r.n_deleted, r.text, r._doc) == (len(lines), len(gone[r.doc_id]), kept, "clash")
    assert sum(map(len, gone.values())) > 6
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontaminate(spark, docs, empty, monkeypatch):
    item = prose(40).split()
    leak = " ".join([prose(20), *item[20:], prose(10), *item[:20], prose(5)])
    items = spark.createDataFrame([(1, " ".join(item), "x"), (1, " ".join(item), "x"), (2, "tiny one", "x"), (3, None, "x"), (4, prose(30), "x"), (5, "", "x")], "item_id long, text string, doc_id string")
    more = docs.select("doc_id", "text", "component_id").union(spark.createDataFrame([(900, leak, ""), (901, "a Tiny, one here", ""), (902, " ".join(item[:20]), "")], "doc_id long, text string, component_id string"))
    want = [(900, 1, 40, 40, 2, 20), (901, 2, 2, 2, 1, 2)]
    assert sorted(map(tuple, decontaminate.contaminated(more, items).collect())) == want
    monkeypatch.setattr(decontaminate, "BENCH_BYTES", 60)  # several passes
    assert sorted(map(tuple, decontaminate.contaminated(more, items).collect())) == want
    assert decontaminate.contaminated(empty, items).count() == decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_packing(docs, empty):
    measured = packing.measured(docs)
    got = packing.pack(measured, capacity=256, shard_docs=10).collect()
    words = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for i, t in plain(docs)}
    facts = {r.id: r for r in measured.collect()}
    bins = {}
    for i, n in words.items():
        mine = sorted(r for r in got if r.id == i)
        assert [r.first_word for r in mine] == [256 * k for k in range(max(1, -(-n // 256)))] and sum(r.n_words for r in mine) == n
        assert n > 0 or mine[0].bin is None
    for r in got:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for some in bins.values():
        some.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(some, some[1:])) and some[-1].bin_offset + some[-1].n_words <= 256
        for kind in ("source", "cluster"):
            held = [v for r in some if (v := facts[r.id][kind]) is not None]
            assert len(set(held)) == len(held)
    assert packing.pack(packing.measured(empty)).count() == 0
    assert packing.pack(packing.measured(docs.withColumn("doc_id", F.lit(None).cast("long")))).count() >= docs.count()


def test_context_tree(docs, empty):
    training = docs.where("doc_id % 2 = 0")
    got = {r.doc_id: r for r in ctw.score(docs, training).collect()}

    def tokens(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]

    counts = {}
    for i, t in plain(docs):
        if i % 2 == 0:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in plain(docs):
        w = tokens(t)
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.n_bytes) == (len(w), sum(x in counts for x in w), n, len(t.encode()) + 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert ctw.score(empty, empty).count() == 0
    blind = ctw.score(docs, empty).collect()
    assert all(math.isclose(r.score, -r.n_bytes * math.log10(256), rel_tol=1e-6) and r.base_score == 0 for r in blind)


def test_context_tree_in_blocks(docs, monkeypatch):
    whole = {r.doc_id: (r.score, r.base_score, r.n_known) for r in ctw.score(docs, docs).collect()}
    monkeypatch.setattr(ctw, "MODEL_BYTES", 400_000)
    monkeypatch.setattr(ctw, "FREQUENT", 20)
    monkeypatch.setattr(ctw, "CHUNK", 3)
    monkeypatch.setattr(ctw, "FLUSH_KEYS", 100)
    for r in ctw.score(docs, docs).collect():
        assert np.allclose((r.score, r.base_score, r.n_known), whole[r.doc_id], rtol=1e-6)


def test_toxicity(spark, docs, empty):
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, prose(int(RNG.integers(5, 200))) + (" Vilest! vilely" if bad else ""), "clash"))
        if i % 3:
            labels.append((i, int(i % 5 > 0), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, is_toxic string")
    known = spark.createDataFrame([*labels, labels[0], (301, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(table, known)
    got = {r.doc_id: r.is_toxic for r in toxicity.score(table, chain).collect()}
    held_out = [i for i in range(0, 300, 3)]
    assert np.mean([got[i] == (i % 4 == 0) for i in held_out]) > 0.97
    assert {r.doc_id for r in toxicity.reject(table, chain).collect()} == {i for i, bad in got.items() if not bad}
    assert toxicity.reject(table, chain).schema == table.schema
    assert toxicity.score(docs, chain).count() == docs.count() and toxicity.score(empty, chain).count() == 0
    for nothing in (toxicity.fit_chain(table, known.where("false")), toxicity.fit_chain(table, known.where("toxic = 0"))):
        assert toxicity.reject(docs, nothing).count() == docs.count()


def test_warc(spark, empty):
    html = ["<p>one</p>", "<p>one</p>", "", None, "é\r\n\r\nWARC/1.1\r\n\r\n", "tail\r\n", "\r\n\r\n", "x" * 70_000, "<p>one</p>"]
    rows = [(i, f"http://a/{i}" if i != 2 else None, h, "clash") for i, h in enumerate(html)] + [(8, "http://a/8", "<p>one</p>", "clash"), (None, "u", "tail\r\n", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, file_records=7)
    got = warc.captures(warc.read_archives(spark, path)).collect()
    assert len(got) == len(rows)  # the repeated row is a capture of its own
    payloads = {(c or "").encode() for _, _, c, _ in rows}
    assert sorted(r.response.type for r in got) == ["response"] * len(payloads) + ["revisit"] * (len(rows) - len(payloads))
    by_id = {r.capture_id: r for r in got}
    for r in got:
        fields = {f.key: f.value for f in r.metadata.fields}
        page = int(fields["page-id"]) if fields["page-id"] else None
        payload = (dict((a, c) for a, _, c, _ in rows)[page] or "").encode()
        assert r.response.payload_bytes == len(payload)
        import base64

        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = [a for a, _, c, _ in rows if (c or "").encode() == payload and a is not None]
        if r.response.type == "response":
            assert page == max(same) and r.response.refers_to is None
        else:
            first = by_id[r.response.refers_to]
            assert r.response.type == "revisit" and {f.key: f.value for f in first.metadata.fields}["page-id"] == str(max(same))
        assert r.request.type == "request" and r.request.concurrent_to == r.capture_id
    nothing = scratch_path(spark, "warc-empty")
    warc.write_archives(pages.where("false"), nothing)
    assert warc.captures(warc.read_archives(spark, nothing)).count() == 0


def test_licences(spark, docs, empty):
    mit = "Copyright (c) 2020 Someone\n\n" + licences.KNOWN[0][1].replace("sublicense", "sub-license").upper().replace(". ", ".\n\n")
    rows = [(1, mit), (2, mit.replace("FREE", "NOT FREE")), (3, "text\nReleased under the MIT Licence\nSPDX-License-Identifier:  Apache-2.0"), (4, None), (5, ""), (6, "***"), (3, "again")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licence, r.notices, r.digest is None) for r in got if r.doc_id != 3) == [
        (1, "MIT", "", False), (2, None, "", False), (4, None, "", True), (5, None, "", False), (6, None, "", False)
    ]
    assert [r.notices for r in got if r.doc_id == 3] == ["Apache-2.0,MIT"] * 2
    own = spark.createDataFrame([("A", "same line"), ("B", "Same LINE!"), ("C", None), ("D", "!!")], "licence string, text string")
    assert {r.notices for r in licences.scan(docs, own).collect()} == {"", "A"}
    assert licences.scan(empty).count() == 0


def test_licences_in_usual_forms(spark):
    wrap = lambda text, width=60: "\n".join(textwrap.wrap(" ".join(text.split()), width, break_on_hyphens=False, break_long_words=False))
    mit, isc = licences.KNOWN[0][1], licences.KNOWN[1][1]
    own = "Copyright (c) 2020 Someone\n\n"
    rows = [("MIT", f"MIT License\n\n{own}{mit}"), ("ISC", f"ISC License\n\n{own}{isc}"), ("MIT", f"The MIT License (MIT)\n{own}{wrap(mit)}")]
    # The usual wrapping, in which a line begins with "copyright notice".
    rows.append(("ISC", own + isc.replace("that the above ", "that the above\n").replace("appear in all ", "appear\nin all ")))
    rows += [("ISC", f"{line}\n{wrap(isc)}") for line in ("Copyright Someone Inc.", "Copyright: 2020 Someone", "(C) 2020 Someone", "(c) Someone", "© Someone", " * Copyright [yyyy] [name]", "Copyright 1999-2004 by notices")]
    for name in licences.WHOLE:
        whole = next(t for n, t in licences.KNOWN if n == name and len(t) > 300)
        rows += [(name, whole), (name, whole.upper())]
        if not re.search(r"(?m)^[ *]*Copyright", whole):
            rows += [(name, own + whole)] + [(name, wrap(whole, width)) for width in range(40, 120)]
        elif "GPL" in name:
            head, rest = whole.split("Everyone", 1)
            rows += [(name, head + wrap("Everyone" + rest.split("END OF TERMS")[0], width)) for width in range(40, 120)]
    rows += [(None, f"{own}{mit} More."), (None, wrap(isc.replace("copyright notice and", ""))), (None, "MIT License")]
    # Wrapped lines that begin with the word are part of the form.
    words = ["notice", "holder", "holders and", "owner", "license to", "laws", "on the", "or", ", patent", "--then", "and certain"]
    want = [(i, n) for i, (n, _) in enumerate(rows)]
    found = licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.licence) for r in found) == want
    lines = spark.createDataFrame([(f"text\ncopyright {w}\nend",) for w in words] + [("text\n(c) You must retain\nend",)], "text string")
    assert all("copyright" in r[0] or "you must" in r[0] for r in lines.select(licences.canonical(F.col("text"))).collect())
    notes = [("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("MIT", "This project is licensed under the MIT License."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.")]
    found = licences.scan(spark.createDataFrame([(i, f"x\n// {t}\ny") for i, (_, t) in enumerate(notes)], "doc_id long, text string")).collect()
    assert [r.notices for r in sorted(found, key=lambda r: r.doc_id)] == [n for n, _ in notes]


def test_learned_partitions(spark):
    rows = [(i, [float(x) for x in RNG.standard_normal(12)], "clash") for i in range(3_000)]
    rows += [(3_000 + i, [1.0] * 12, "clash") for i in range(600)]
    odd = [(5_000, None, ""), (5_100, [0.0] * 12, ""), (5_200, [float("nan")] * 12, ""), (5_300, [1.0] * 11 + [float("inf")], ""), (5_400, [1.0] * 5, ""), (5_500, [None] + [1.0] * 11, "")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, part string")
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    found = learned_partitions.search(table, F.col("vec_id") % 100 == 0, part_rows=400).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(by_query) == [i for i in range(3_600) if i % 100 == 0]
    hits = 0
    for q, mine in by_query.items():
        mine.sort()
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        far[q] = np.inf
        best = sorted(zip(far, ids))[:10]
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == far[m[1]] for m in mine) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in best})
        if q >= 3_000:
            assert [m[1] for m in mine] == [i for _, i in best]
    assert hits >= 0.9 * 10 * len(by_query)
    few = learned_partitions.search(table.where("vec_id < 4 or vec_id >= 5000"), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(q, k) for q in (0, 2) for k in (1, 2, 3)]
    assert learned_partitions.search(table.where("false"), F.col("vec_id") % 2 == 0).count() == 0


def test_pipeline_stages(spark, docs, empty, tmp_path):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    item = prose(40)
    more = spark.createDataFrame([(700, f"{prose(30)} {item} {prose(30)}", "en", "s", 1), (None, prose(50), None, None, None)], base.schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    base.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.schema.names == base.schema.names
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append([r.doc_id for r in kept.collect()])
    assert len(ids[0]) == base.count() + 2 and 700 in ids[2] and 700 not in ids[3] and None in ids[3]
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(ids[3])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.where("false"), str(tmp_path)).count() == 0
