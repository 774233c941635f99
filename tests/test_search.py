"""Dense, lexical, fused, reranked and compressed results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satchel.operators import dense
from satchel.operators.ann import approximate_topk, assign_cells, recall_at_k, train_cells
from satchel.operators.compress import compress
from satchel.operators.dense import dense_topk, nearest
from satchel.operators.embedding import embed, hash_embed
from satchel.operators.lexical import build_postings, lexical_matches
from satchel.operators.points import to_points
from satchel.operators.rerank import apply_hits, rerank_by, reorder_by, rerank_with, term_overlap
from satchel.plans.context import contexts
from satchel.plans.search import search, with_defaults

ASKED = [2, 1, 0, 1]
VECTORS = {"reed": [0, 1, 1, 0], "dune": [1, 0, 0, -1], "fen": [0.5, 2, 1, 0.25], "lake": [4, 2, 0, 2], "moor": [1, 0.5, 0, 0.5], "weir": [-1, 3, 2, 0]}
TEXTS = {
    "reed": "reeds grow in slowWater", "dune": "sand shifts with the wind", "fen": "a fen lives on slowWater and rain",
    "lake": "still surface, far shore", "moor": "open ground under heather", "weir": "boards raise the stream",
}


@pytest.fixture(scope="module")
def points(spark):
    rows = [("p", i, TEXTS[i], {"source_file": f"{i}.go"}, [float(x) for x in VECTORS[i]]) for i in TEXTS]
    rows.append(("q", "reed", TEXTS["reed"], {"source_file": "other.go"}, [float(x) for x in ASKED]))
    df = spark.createDataFrame(rows, "project_id string, id string, content string, meta map<string,string>, embedding array<float>")
    return to_points(df, "m").persist()


def asked(spark, *queries, **options):
    rows = [(f"q{i}", "p", q, [float(x) for x in ASKED]) for i, q in enumerate(queries)]
    df = spark.createDataFrame(rows, "query_id string, project_id string, query string, qvec array<float>")
    for name, value in options.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_defaults(spark):
    row = with_defaults(asked(spark, "x", k=0, recall=-3)).first()
    assert (row["k"], row["recall"], row["hybrid"], row["rerank"], row["compress"]) == (5, 40, True, True, False)


def test_project_isolation_and_ties(spark, points):
    got = dense_topk(points, asked(spark, "x", recall=40)).orderBy("rank").collect()
    assert {r["project_id"] for r in got} == {"p"} and len(got) == 6
    # Two point the same way as the question: they tie and come in id order.
    assert [r["id"] for r in got[:2]] == ["lake", "moor"] and got[0]["score"] == got[1]["score"] == 1.0


def test_hybrid_prefers_keyword_hits(spark, points):
    got = search(asked(spark, "slowWater", "heather", "shifts"), points).results.collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["id"]] = r
    assert by["q0"]["reed"]["in_lexical"] and by["q0"]["fen"]["in_lexical"]
    assert by["q1"]["moor"]["rank"] == 1
    assert by["q2"]["dune"]["in_lexical"]


def test_dense_only_has_no_origin(spark, points):
    run = search(asked(spark, "slowWater", hybrid=False), points)
    comp = run.composition().first()
    assert (comp["candidates"], comp["dense_count"], comp["lexical_count"], comp["results"]) == (6, 0, 0, 5)
    assert not comp["hybrid"] and not comp["reranked"]


def test_question_without_candidates(spark, points):
    lost = asked(spark, "slowWater").withColumn("project_id", F.lit("nowhere"))
    run = search(lost, points)
    assert run.results.count() == 0
    comp = run.composition().first()
    assert (comp["candidates"], comp["results"]) == (0, 0)
    assert contexts(lost, run.results).first()["context"] == ""


def brute(points, queries, k):
    out = {}
    for qid, group, qv in queries:
        scored = []
        for g, pid, v in points:
            if g == group:
                a, b = np.array(qv), np.array(v)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                scored.append((-round(float(a @ b / size) if size else 0.0, 12), pid))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("route", ["travelling", "rounds", "bytes"])
def test_dense_routes_equal_brute_force(spark, monkeypatch, route):
    """One group and one vector hold a large share of all rows."""
    rng = random.Random(3)
    hot = [1.0, 0.5, -0.5, 0.25]
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else f"g{i % 5}"
        vector = hot if i % 4 == 0 else [float(np.float32(rng.uniform(-1, 1))) for _ in range(4)]
        rows.append((group, f"id{i:04d}", vector))
    questions = [(f"q{i}", "hot" if i % 2 else f"g{i % 5}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(37)]
    questions = [(a, b, [float(np.float32(x)) for x in c]) for a, b, c in questions]
    if route == "rounds":
        monkeypatch.setattr(dense, "PACKED_QUERIES", 5)
    elif route == "bytes":
        monkeypatch.setattr(dense, "PACKED_QUERY_BYTES", 700)
    else:
        monkeypatch.setattr(dense, "CELLS_AT_ONCE", 500)
    pts = spark.createDataFrame(rows, "project_id string, id string, embedding array<float>").repartition(7)
    qs = spark.createDataFrame(questions, "query_id string, project_id string, qvec array<float>").withColumn("recall", F.lit(11))
    got = {}
    for r in dense_topk(pts, qs).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: ids for q, ids in brute(rows, questions, 11).items() if ids}
    # Points are scanned where they lie: no row of theirs is copied or shuffled.
    assert "Generate" not in dense_topk(pts, qs)._jdf.queryExecution().executedPlan().toString()


def test_dense_bound_per_question(spark, points):
    qs = asked(spark, "a", "b").withColumn("recall", F.when(F.col("query_id") == "q0", 2).otherwise(4))
    got = {r["query_id"]: r["n"] for r in dense_topk(points, qs).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"q0": 2, "q1": 4}


def test_nearest_agrees_with_batch(spark, points):
    one = [r["id"] for r in nearest(points.where("project_id = 'p'"), [float(x) for x in ASKED], 4).collect()]
    many = [r["id"] for r in dense_topk(points, asked(spark, "x", recall=4)).orderBy("rank").collect()]
    assert one == many


def test_mixed_dimensions_are_an_error(spark):
    pts = spark.createDataFrame([("p", "a", [1.0]), ("p", "b", [1.0, 2.0])], "project_id string, id string, embedding array<float>").coalesce(1)
    qs = spark.createDataFrame([("q", "p", [1.0, 2.0], 3)], "query_id string, project_id string, qvec array<float>, recall int")
    with pytest.raises(Exception, match="components"):
        dense_topk(pts, qs).collect()


@pytest.mark.parametrize("stored", [False, True])
def test_lexical_routes_equal_brute_force(spark, stored):
    """A word in every text, and one text copied many times."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    texts = []
    for i in range(300):
        words = ["the", "copy", "of", "it"] if i % 3 == 0 else ["the"] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))]
        texts.append((f"p{i % 2}", f"id{i}", " ".join(words)))
    asks = [("q0", "p0", "the"), ("q1", "p1", "THE copy"), ("q2", "p0", "w1 w2 w1"), ("q3", "p1", "absent the"), ("q4", "p0", "?!"), ("q5", "p1", "w3, w4 the")]
    expect = set()
    for qid, p, q in asks:
        terms = set("".join(c if c.isalnum() else " " for c in q.lower()).split())
        for g, i, content in texts:
            words = content.split()
            if terms and g == p and terms <= set(words):
                expect.add((qid, i, sum(w in terms for w in words)))
    pts = spark.createDataFrame(texts, "project_id string, id string, content string")
    qs = spark.createDataFrame(asks, "query_id string, project_id string, query string")
    source = {"postings": build_postings(pts)} if stored else {"points": pts}
    got = {(r["query_id"], r["id"], r["lex_score"]) for r in lexical_matches(qs, **source).collect()}
    assert got == expect


def test_postings_positions(spark):
    pts = spark.createDataFrame([("p", "a", "x y x"), ("p", "b", ""), ("p", "c", "Y")], "project_id string, id string, content string").coalesce(1)
    got = {(r["id"], r["term"]): (r["tf"], r["positions"]) for r in build_postings(pts).collect()}
    assert got == {("a", "x"): (2, [0, 2]), ("a", "y"): (1, [1]), ("c", "y"): (1, [0])}


def ranked(spark, rows):
    df = spark.createDataFrame(rows, "id string, content string, score double, content_hash string")
    return df.withColumn("query_id", F.lit("q")).withColumn("rank", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("query_id").orderBy(F.col("score").desc())))


def test_compress_fixture(spark):
    # n drops b by its digest; the text of o, already dropped with n, does not count against r.
    rows = [("m", "oak", 7.0, "d7"), ("n", "elm", 6.5, "d7"), ("o", "ash", 4.0, "d2"), ("p", "ash", 3.0, None), ("r", "elm", 2.0, "d9"), ("s", "fir", 1.0, "")]
    assert [r["id"] for r in compress(ranked(spark, rows)).orderBy("rank").collect()] == ["m", "o", "r", "s"]


def test_compress_equals_the_sequential_rule(spark):
    rng = random.Random(11)
    rows, expect = [], {}
    for q in range(80):
        kept, hashes, texts = [], set(), set()
        for n in range(12):
            digest, content = rng.choice(["", None, "h1", "h2", "h3"]), rng.choice("abcd")
            rows.append((f"q{q}", n + 1, digest, content))
            if digest:
                if digest in hashes:
                    continue
                hashes.add(digest)
            if content in texts:
                continue
            texts.add(content)
            kept.append(n + 1)
        expect[f"q{q}"] = kept
    got = {}
    df = spark.createDataFrame(rows, "query_id string, rank int, content_hash string, content string")
    for r in compress(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert got == expect


def ten(spark, k=5):
    rows = [("q", "question", i + 1, f"result-{i}", f"content-{i}", (10 - i) / 10, k, True) for i in range(10)]
    return spark.createDataFrame(rows, "query_id string, query string, rank int, id string, content string, score double, k int, rerank boolean")


@pytest.mark.parametrize(
    "hits, k, expect",
    [
        ([(3, 7.5), (8, 7.0), (0, 6.5)], 5, ["result-3", "result-8", "result-0"]),
        ([(6, 0.31), (1, 0.3), (9, 0.2), (2, 0.1)], 3, ["result-6", "result-1", "result-9"]),
        ([(41, 3.0), (-2, 2.0), (5, 1.0)], 5, ["result-5"]),
        ([], 5, [f"result-{i}" for i in range(5)]),
        (None, 5, [f"result-{i}" for i in range(5)]),
    ],
)
def test_rerank_hits(spark, hits, k, expect):
    def scorer(question, texts, wanted):
        if hits is None:
            raise RuntimeError("down")
        return hits

    rows = ten(spark, k)
    got = apply_hits(rows, rerank_with(rows, scorer)).orderBy("rank").collect()
    assert [r["id"] for r in got] == expect
    assert all(r["reranked"] == bool(hits) for r in got)
    if hits and hits[0][0] == 3:
        assert got[0]["score"] == 7.5 and [r["moved"] for r in got] == [True, True, True]


def test_expression_and_hits_agree(spark):
    rows = ten(spark).withColumn("content", F.concat(F.lit("question word"), F.when(F.col("rank") % 3 == 0, F.lit(" other")).otherwise("")))
    score = term_overlap(F.lit("other question"), F.col("content"))
    a = apply_hits(rows, rerank_by(rows, score)).orderBy("rank").select("id", "score", "rank", "moved").collect()
    b = reorder_by(rows, score).orderBy("rank").select("id", "score", "rank", "moved").collect()
    assert a == b and a[0]["id"] == "result-2"


def test_embed_batches_and_count_check(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("content")).coalesce(1)

    def good(texts):
        assert len(texts) <= 32
        return [[float(s)] for s in texts], 17

    got = embed(rows, good, batch_size=32, counts_tokens=True)
    back = got.select("content", F.get("embedding", F.lit(0)).alias("x"), "tokens").collect()
    assert all(float(r["content"]) == r["x"] for r in back) and sum(r["tokens"] for r in back) == 17 * 10
    with pytest.raises(Exception, match="vectors for"):
        embed(rows, lambda texts: [[0.0]], batch_size=64).collect()


def test_hash_embedding_is_stable(spark):
    rows = spark.createDataFrame([("a b b",), ("",), ("B, A b!",)], "content string").repartition(3)
    got = {r["content"]: r["embedding"] for r in hash_embed(rows, dim=16).collect()}
    assert got["a b b"] == got["B, A b!"] and set(got[""]) == {0.0}
    assert abs(sum(x * x for x in got["a b b"]) - 1) < 1e-6


def test_cells_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    rows = [("p", f"{i:04d}", [float(x) for x in centres[i % 8] + 0.2 * rng.normal(size=16)]) for i in range(800)]
    pts = spark.createDataFrame(rows, "project_id string, id string, embedding array<float>")
    qs = pts.limit(20).select(F.col("id").alias("query_id"), "project_id", F.col("embedding").alias("qvec"), F.lit(10).alias("recall"))
    cells = train_cells(pts, 8)
    placed = assign_cells(pts, cells)
    exact = dense_topk(pts, qs)
    some = recall_at_k(approximate_topk(placed, qs, cells, 2), exact).first()["recall"]
    everything = recall_at_k(approximate_topk(placed, qs, cells, 8), exact).first()["recall"]
    assert everything == 1.0 and some > 0.8


def test_small_means_rows_and_bytes(spark):
    from satchel.session import is_small

    df = spark.range(50).select(F.repeat(F.lit("x"), 100).alias("a"), F.array(F.lit("y")).alias("b"))
    assert is_small(df, 50, 10_000) and not is_small(df, 49, 10_000) and not is_small(df, 50, 5_000)
    assert is_small(df.where("false"))


def test_search_without_broadcast(spark, points, monkeypatch):
    """The shuffled routes give the same answer."""
    from satchel import session
    from satchel.operators import lexical

    queries = asked(spark, "slowWater", "heather ground", "absent word", compress=True)
    columns = ["query_id", "id", "rank", "score", "in_dense", "in_lexical"]
    scorer = term_overlap(F.col("query"), F.col("content"))
    first = sorted(map(tuple, search(queries, points, scorer=scorer).results.select(*columns).collect()))
    monkeypatch.setattr(session.is_small, "__defaults__", (0, 0))
    monkeypatch.setattr(session.few_rows, "__defaults__", (0, 0))
    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0,))
    monkeypatch.setattr(lexical, "SMALL_ROWS", 0)
    monkeypatch.setattr(dense, "PACKED_QUERIES", 1)
    assert sorted(map(tuple, search(queries, points, scorer=scorer).results.select(*columns).collect())) == first


def test_context_string(spark):
    rows = ten(spark, 2).where("rank <= 2")
    assert contexts(rows.select("query_id").distinct(), rows).first()["context"] == "[score 1.000] content-0\n\n[score 0.900] content-1"


def test_postings_carry_the_place_of_their_point_in_word_order(spark):
    rows = [("p", f"d{i}", None if i % 7 == 0 else " ".join(f"w{i * k % 13}" for k in range(i % 5 + 1)), i // 6, None if i >= 12 else "k") for i in range(30)]
    pts = spark.createDataFrame(rows, "project_id string, id string, content string, bucket int, project_key string").coalesce(1)
    got = build_postings(pts, carried=["project_key", "bucket"]).collect()
    want = set()
    for _, i, content, bucket, key in rows:
        words = (content or "").split()
        want |= {(i, w, words.count(w), tuple(k for k, x in enumerate(words) if x == w), key, bucket) for w in words}
    assert {(r["id"], r["term"], r["tf"], tuple(r["positions"]), r["project_key"], r["bucket"]) for r in got} == want and len(got) == len(want)
    order = [(r["bucket"], r["term"]) for r in got]
    assert order == sorted(order)
