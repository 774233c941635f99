"""Conversation repair, secret scans and spelling variants against brute force."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from satchel.llm import conversations, queries, secret_scan, spelling, words  # noqa: E402

RNG = random.Random(5)
WHITE = " \t\n\x0b\x0c\r"


# --- conversations ------------------------------------------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string, absent string, piece int"
ROLES = ["user", "assistant", "system", "tool", "", None, "umpire", "User"]
TEXTS = ["yes.", "no", "", " \n", None, "why?  ", "so!\n", "cut off", "·"]


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        black = text.rstrip(WHITE)
        out.append("blank" if not black else "duplicate" if (role, text) in seen else "" if black[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def ways(rows, faults):
    """Every edit list with up to two empty turns in a gap."""
    fill = [()] + [(x,) for x in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    each = []
    for (_, role, text), fault in zip(rows, faults):
        some = [("D", None, 4)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            some += [("K", f"{role}:{text}", more)] if role else []
            some += [("R", f"{r}:{text}", 3 + more) for r in ("user", "assistant")]
        each.append(some)
    for gaps in itertools.product(fill, repeat=len(rows) + 1):
        for edits in itertools.product(*each):
            yield gaps, edits


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, best = faults_of(rows), None
    for gaps, edits in ways(rows, faults):
        cost, audit, lines = 0, "", []
        for k, gap in enumerate(gaps):
            for role in gap:
                cost, audit = cost + 3, audit + "I"
                lines.append(f"{role}:")
            if k < len(edits):
                letter, line, more = edits[k]
                cost, audit = cost + more, audit + letter
                lines += [line] if line is not None else []
        if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)):
            way = (cost, audit, lines)
            best = min(best or way, way)
    turns = {r[0] for r in rows} - {None}
    firsts = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def some_conversations():
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(RNG.randint(1, 3)):
            role = RNG.choice(ROLES if RNG.random() < 0.3 else ROLES[:3])
            rows.append((conv, RNG.choice([turn, turn, 2 * turn, None]), role, RNG.choice(TEXTS), "clash", 7))
    return rows + rows[5:7]


def told(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[n] for n in names) for r in df.collect()}


def plain_rows(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


@pytest.fixture(scope="module")
def talk():
    rows = some_conversations()
    return rows, {conv: brute(x) for conv, x in plain_rows(rows).items()}


def test_repair_by_brute_force(spark, talk):
    rows, want = talk
    assert told(conversations.report(spark.createDataFrame(rows, ROWS).drop("absent").repartition(3))) == want
    assert len({w[6] for w in want.values()}) > 20 and any("R" in w[6] for w in want.values())


def test_long_conversations_by_pieces(spark, talk, monkeypatch):
    rows, want = talk
    monkeypatch.setattr(conversations, "SHORT_ROWS", 1)
    monkeypatch.setattr(conversations, "PIECE_ROWS", 2)
    df = spark.createDataFrame(rows, ROWS).drop("absent")
    assert told(conversations.report(df)) == want
    both = {}
    for r in conversations.repaired(df).where("edit <> 'D'").orderBy("conv_id", "place").collect():
        both.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in both.items()} == {c: w[7] for c, w in want.items() if w[7] != hashlib.sha256(b"").hexdigest()}


def test_one_conversation_of_all_rows(spark, monkeypatch):
    """A hot conversation with thousands of equal rows gives what the plain way gives."""
    rows = [(1, t // 3, RNG.choice(ROLES[:3]), RNG.choice(["a.", "b", f"c{t}."]), False, 0) for t in range(3000)] + [(1, 5, "user", "same.", False, 0)] * 2000
    rows += [(None, None, "user", "x.", True, 0), (2, 1, "user", "gone", True, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, absent boolean, piece int")
    monkeypatch.setattr(conversations, "SHORT_ROWS", 100_000)
    short = told(conversations.report(df))
    monkeypatch.setattr(conversations, "SHORT_ROWS", 100)
    assert told(conversations.report(df)) == short
    assert len(short[1][6]) >= 5000 and short[2] == short[None] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_other_costs(spark):
    """With dear deletions even a lone system turn gets an exchange."""
    df = spark.createDataFrame([(1, 0, "system", "s.")], "conv_id long, turn long, role string, text string")
    assert told(conversations.report(df, conversations.Costs(delete=50, rerole=50)))[1][5:7] == (6, "KII")


def test_damage_and_empty_conversations(spark):
    rows = [(c, t, r, x) for c in [None, *range(30)] for t, r, x in ((0, "user", "a. b!"), (None, None, None), (3, "assistant", "c?"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        made = [] if kind == 0 else [("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)]
        want.setdefault(conv, []).extend((turn, *x) for x in made * (2 if kind == 3 else 1))
    got = told(conversations.report(conversations.damage(df)))
    assert got == {c: brute(x) for c, x in want.items()}
    assert conversations.report(conversations.damage(df.where("turn > 99"))).count() == 0


# --- secrets ------------------------------------------------------------------------------------------

def secret_texts():
    key = "".join(RNG.choice("ABCDEFGHIJKLMNOP0123456789") for _ in range(30))
    return [
        None, "", "nothing here", f"AKIA{key[:16]}", f"AKIAAKIA{key[:14]} AKIA12", "é€𝄞 PassWord = \"abcdefghijkl\" x", "passwd:short", "API_KEY:'0123456789abcdef0123'",
        "apikey=abc.def.ghi.jkl token=abc", "deadbeefdeadbeefdeadbeef", "deadbeefdeadbee", "ſecret=abcdefghijklmn", "toKen=abcdefghijklmn", "secret" * 5000 + "=" + "a" * 20,
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", f"ghp_{key}{key}", "xoxb-123456789012-abc", f"AIza{key}{key}", "https://me:pass1@host/x", "ftp://a/b:c@d",
        "token=token=token=abcdefghijklmn", "a" * 200_000, "password " * 3 + "\n" + "f" * 16, "secret:abcdefghijkl", "secret:abcdefghijkl",
    ]


def test_scan_by_plain_search(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 300)
    monkeypatch.setattr(secret_scan, "STEP", 64)
    texts = secret_texts()
    rows = [(None if i % 7 == 3 else i // 2, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, id string").repartition(2)
    got = sorted((r.id is None, r.id or 0, tuple((s.kind, s.start, s.end) for s in r.found)) for r in secret_scan.scan(df).collect())
    want = []
    for i, text, *_ in rows:
        spans = []
        for k, rule in enumerate(secret_scan.RULES):
            flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
            spans += [(m.start(), k, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "", flags) if len(m[rule.group]) >= rule.least]
        want.append((i is None, i or 0, tuple((kind, a, b) for a, _, kind, b in sorted(spans))))
    assert got == sorted(want)
    assert {s[0] for w in want for s in w[2]} == {r.kind for r in secret_scan.RULES}
    assert secret_scan.scan(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("pattern", ["abc|abd", "(?:ab)?cdef", "x[yz]{2}w+", "a.*bcd", "(foo|ba[rz])+qux", "^héllo$", "[^a]bcd", "(?i:abc)de", "ab{3,}c", "a*", "q(?:uick|uiet)ly"])
def test_trigram_queries_hold_for_every_match(pattern):
    """Texts in which an expression matches satisfy its query; strings are drawn near the pattern's letters."""
    query, compiled = secret_scan.trigram_query(pattern), re.compile(pattern, re.ASCII)
    wanted = np.array(sorted(int.from_bytes(g, "big") for g in secret_scan.query_grams(query)), dtype=np.int64)
    letters = sorted({c for c in pattern if c.isalpha()}) + ["é"]
    texts = ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 14))) for _ in range(3000)]
    texts += ["xyzww", "abcdef", "cdef", "foobarqux", "bazqux", "héllo", "xbcd", "ABCde", "abbbbc", "quickly", "quietly", "a123bcd", "abd"]
    blobs = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    index = secret_scan.Postings(np.frombuffer(b"".join(blobs), dtype=np.uint8), offsets, wanted)
    candidates = set(index.answer(query).tolist())
    assert {i for i, t in enumerate(texts) if compiled.search(t)} <= candidates
    if query != secret_scan.ALWAYS:
        assert len(candidates) < len(texts) / 2


# --- spelling -----------------------------------------------------------------------------------------

def apart(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(n):
    out = {w: {x for x in n if apart(w, x)} for w in n}
    forms = {}
    for w, near in out.items():
        if near:
            best = min(near, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                forms[w] = best
    result = {}
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        result[w] = (n[w], len(out[w]), forms.get(w), n.get(forms.get(w)), root)
    return result


def answer(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def some_words():
    base = ["".join(RNG.choice("abé") for _ in range(RNG.randint(5, 9))) for _ in range(250)]
    return {w: RNG.choice([3, 3, 4, 7, 8, 20, 60, 200]) for w in [*base, *(w + "s" for w in base[:40]), *("x" + w for w in base[:40]), "aaaaa", "aaaaaa", "aaaaaaa", "ÿ" * 300, "ÿ" * 301]}


@pytest.mark.parametrize("longest", [50_000, 6])
def test_variants_by_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(spelling, "LIST_WORDS", longest)
    monkeypatch.setattr(spelling, "BAG_LETTERS", 5_000)
    monkeypatch.setattr(spelling, "QUERIES", 16)
    n = some_words()
    want = spelled(n)
    assert answer(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == want
    assert sum(w[2] is not None for w in want.values()) > 50


def test_short_words_and_chains(spark):
    n = {"a": 1, "b": 2, "ab": 4, "abc": 8, "abcd": 16, "zbcd": 40, "zbcde": 100}
    assert answer(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == spelled(n)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_counted_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 20)
    texts = [None, "", "Straße STRASSE straße Ärger äRGER ärger×÷x", "naïve's NAÏVE naïve " * 3, "long" * 60_000, "1234 ____", "word_word-words words wordS"] * 2
    texts += [" ".join(RNG.choice(["colour", "color", "Colour", "flavour"]) for _ in range(40)) for _ in range(40)]
    rows = [(None if i % 5 == 4 else i // 2, t, "clash", 1) for i, t in enumerate(texts)]
    total = Counter()
    for key, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low.replace("K", " ")):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    want = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    assert {r.word: r.n for r in spelling.count_words(df, slip=97).collect()} == want and "long" * 60_000 not in want


def test_queries_on_awkward_tables(spark, tmp_path):
    """The registered queries on tables with nulls in every column, repeated rows and names that clash."""
    docs = spark.createDataFrame([(None, None, None), (1, "secret=abcdefghijklmnop", "a"), (1, "secret=abcdefghijklmnop", "b"), (2, "", "c")], "doc_id long, text string, found string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    talk = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", "a.", 1), (1, 0, "user", "a.", 1)], "conv_id long, turn long, role string, text string, absent int")
    talk.select("conv_id", "turn", "role", "text", F.col("absent").alias("cost")).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(r.n_assign for r in queries.QUERIES["op12_secret_scan"](spark, str(tmp_path)).collect()) == [0, 0, 1, 1]
    assert queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 2
    assert queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path)).count() == 0


# --- awkward ids of earlier operators ------------------------------------------------------------------

def test_line_runs_of_rows_without_or_with_equal_ids(spark):
    """Lines of two rows are never read as one document; a row that repeats counts once."""
    from satchel.llm import line_dedup

    x, y = "x" * 150, "y" * 150
    rows = [(None, f"{x}\nA"), (None, f"B\n{y}"), (9, f"{x}\n{y}"), (1, f"{x}\nc"), (1, f"d\n{y}"), (2, f"{x}\n{y}\ne"), (2, f"{x}\n{y}\ne"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_deleted) for r in line_dedup.dedup_lines(df).collect())
    want = [(None, f"{x}\nA", 0), (None, f"B\n{y}", 0), (9, "", 2), (1, f"{x}\nc", 0), (1, f"d\n{y}", 0), (2, f"{x}\n{y}\ne", 0), (2, f"{x}\n{y}\ne", 0), (3, "", 0), (3, "", 0)]
    assert got == sorted((i is None, i or 0, t, n) for i, t, n in want)
    alone = df.where("doc_id = 9 OR doc_id IS NULL OR doc_id = 1")
    assert all(r.n_deleted == 0 for r in line_dedup.dedup_lines(alone).collect())


def test_archives_of_pages_without_id_and_of_repeated_rows(spark, tmp_path):
    import duckdb

    rows = [(None, "u", "a"), (None, None, "a"), (4, "u", "a"), (4, "u", "a"), (3, "", None), (None, "v", ""), (5, "w", "é"), (None, "w", "only")] * 2
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.QUERIES["op4_warc"](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.OP4_SQL})").fetchall()
    assert got == sorted(found, key=repr) and len(got) == len(rows)


def test_shards_of_rows_that_share_an_id(spark):
    from satchel.llm import packing

    rows = [(None, "s", 5, 10)] * 900 + [(7, f"t{i}", None, 10) for i in range(300)] + [(i, f"s{i % 9}", i, 1 + i % 40) for i in range(400)]
    items = spark.createDataFrame(rows, "id long, source string, cluster long, n_words int").repartition(3)
    done = packing.pack(items, capacity=100, shard_docs=50).toPandas()
    assert len(done) == len(rows) and done.n_words.sum() == sum(r[3] for r in rows)
    shard = done.bin.str.rsplit("-", n=1).str[0]
    assert shard.value_counts().max() <= 4 * 50
    assert done.groupby("bin").n_words.sum().max() <= 100
