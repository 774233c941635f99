"""Word and cell indexes of a store against searches without them."""

import pytest
from pyspark.sql import functions as F

from satchel.operators.ann import recall_at_k
from satchel.operators.bm25 import bm25
from satchel.operators.dense import dense_topk
from satchel.operators.lexical import lexical_matches
from satchel.plans.search import embed_queries, search
from satchel.plans.sync import chunk_points, index_documents
from satchel.sources import indexes
from satchel.sources.indexes import CellIndex, WordIndex
from satchel.sources.store import PointStore

WORDS = ["river", "stone", "light", "öl", "green", "cloud", "door", "paper", "seven", "north"]
DOCUMENT = "id string, content string, meta map<string,string>"


def texts(n, seed=0):
    out = []
    for i in range(n):
        a = (i * 7 + seed) % 10
        out.append(" ".join(WORDS[(a + j * j) % 10] for j in range(1 + (i + seed) % 9)))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, {}) for i, t in rows], DOCUMENT)


def questions(spark, rows):
    asked = spark.createDataFrame(rows, "query_id string, project_id string, query string")
    return embed_queries(asked).withColumn("recall", F.lit(7)).withColumn("k", F.lit(4))


def found(df):
    return {(r.query_id, r.project_id, r.id): r.lex_score for r in df.collect()}


@pytest.fixture
def asked(spark):
    return questions(spark, [("a", "p", "river stone"), ("b", "p", "Stone!"), ("c", "q", "light öl door"), ("d", "q", "absent river"), ("e", "none", "river"), ("f", "p", "??"), ("g", "p", "north north paper")])


def test_word_index_through_changes(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(indexes, "SPAN_DOCS", 4)
    store = PointStore(spark, str(tmp_path / "s"), buckets=3)
    index_documents(store, documents(spark, [(f"d{i}", t) for i, t in enumerate(texts(40, 3))]), "p")
    words = WordIndex.create(store, 5)
    with pytest.raises(ValueError):
        WordIndex.create(store, 5)

    def same(weighed=False):
        points = store.points()
        assert found(words.matches(asked)) == found(lexical_matches(asked, points))
        if not weighed:
            return
        assert found(words.matches(asked, bm25())) == pytest.approx(found(lexical_matches(asked, points, weigh=bm25())), abs=1e-8)
        tokens = points.select("project_id", "id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}]+)"))).alias("term"))
        plain = tokens.groupBy(F.substring(F.sha2("project_id", 256), 1, 16).alias("project_key"), "term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("tf"))
        kept = words.statistics()[0]
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect()))

    index_documents(store, documents(spark, [(f"d{i}", t) for i, t in enumerate(texts(25))] + [("void", ""), ("marks", "?!")]), "p")
    index_documents(store, documents(spark, [(f"e{i}", t) for i, t in enumerate(texts(30, 5))]), "q")
    store.delete_points(store.points(["p"]).where("id < 'd2'"))
    same(weighed=True)
    # A store opened anew keeps its index up as well.
    other = PointStore(spark, str(tmp_path / "s"))
    index_documents(other, documents(spark, [("z", "river stone river")]), "p")
    same()
    assert ("a", "p", "z") in found(words.matches(asked))
    other.delete_project("q")
    other.vacuum()
    same()


def test_many_questions_take_the_joined_way(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(indexes, "FEW_WORDS", 1)
    monkeypatch.setattr(indexes, "LITERALS", 1)
    store = PointStore(spark, str(tmp_path / "s"), buckets=2)
    words = WordIndex.create(store, 3)
    index_documents(store, documents(spark, [(f"d{i}", t) for i, t in enumerate(texts(60))]), "p")
    assert found(words.matches(asked)) == found(lexical_matches(asked, store.points())) != {}


def test_a_question_reads_the_folders_of_its_words(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), buckets=1)
    words = WordIndex.create(store, 50)
    index_documents(store, documents(spark, [(f"d{i}", t) for i, t in enumerate(texts(60))]), "p")
    asked = questions(spark, [("a", "p", "river")])
    seen = []
    monkey = words._alive
    words._alive = lambda rows: seen.append(rows) or monkey(rows)
    assert words.matches(asked).count() > 0
    files = {f.split("wb=")[1].split("/")[0] for f in spark.createDataFrame(seen[0].select(F.input_file_name().alias("f")).distinct().collect()).toPandas()["f"]}
    assert len(files) == 1


def test_empty_store(spark, tmp_path, asked):
    store = PointStore(spark, str(tmp_path / "s"), buckets=2)
    words = WordIndex.create(store, 3)
    assert words.matches(asked).count() == 0 and words.matches(asked, bm25()).count() == 0


@pytest.fixture
def vectors(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "v"), buckets=2)
    index_documents(store, documents(spark, [(f"d{i}", t) for i, t in enumerate(texts(120))]), "p")
    cells = CellIndex.create(store, 6)
    index_documents(store, documents(spark, [(f"e{i}", t) for i, t in enumerate(texts(80, 4))]), "q")
    store.delete_points(store.points(["p"]).where("id LIKE 'd1%'"))
    return store, cells


def hits(df):
    return sorted((r.query_id, r.id, r.score, r.rank) for r in df.collect())


@pytest.mark.parametrize("few", [1_000, 1])
def test_cells(spark, vectors, asked, few, monkeypatch):
    if few == 1:
        monkeypatch.setattr(indexes, "few_rows", lambda df: None)
    store, cells = vectors
    exact = dense_topk(store.points(), asked)
    assert hits(cells.topk(asked, 6)) == hits(exact)
    some = cells.topk(asked, 2)
    scores = {(q, i): s for q, i, s, _ in hits(dense_topk(store.points(), asked.withColumn("recall", F.lit(1_000))))}
    assert all(scores[q, i] == s for q, i, s, _ in hits(some))
    assert 0 < recall_at_k(some, exact).first()["recall"] <= 1


def test_probes_reach_the_recall(vectors, asked):
    store, cells = vectors
    assert 1 <= cells.probes_for(0.5) <= cells.probes_for(0.9) <= cells.probes_for(1.0) <= 6


def test_cells_are_pruned_at_the_scan(vectors, asked):
    _, cells = vectors
    plan = cells.topk(asked.where("query_id = 'a'"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "IN (" in plan


def test_search_through_indexes(spark, vectors, asked):
    store, cells = vectors
    words = WordIndex.create(store, 4)
    plain = search(asked, store.points())
    through = search(asked, store.points(), buckets=2, words=words, cells=cells, probes=6)
    rows = lambda a: sorted((r.query_id, r.id, r.rank, round(r.score, 9), r.in_dense, r.in_lexical) for r in a.results.collect())
    assert rows(plain) == rows(through)
    weighed = search(asked, store.points(), words=words, weigh=bm25())
    assert rows(weighed) == rows(search(asked, store.points(), weigh=bm25()))


def test_chunks_follow_a_changed_file(spark, tmp_path, asked):
    """Upserts of a commit that replaces a whole bucket leave no old postings."""
    store = PointStore(spark, str(tmp_path / "s"), buckets=1)
    words = WordIndex.create(store, 2)
    chunk = "project_id string, source_dir string, source_file string, position int, id string, chunk string, content_hash string, content string"
    old = spark.createDataFrame([("p", "s", "f", 0, "s/f#chunk0", "river", "h", "river")], chunk)
    store.upsert(chunk_points(old))
    store.upsert(chunk_points(old.withColumn("content", F.lit("stone"))))
    assert set(found(words.matches(asked))) == {("b", "p", "s/f#chunk0")}


def test_the_length_of_a_vector_is_made_once(spark):
    from satchel.operators.ann import unit_vector

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],)], "v array<float>").select(unit_vector(F.col("v")).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 1.0]]
    made = df._jdf.queryExecution().analyzed().toString()
    assert "aggregate" in made and "aggregate" not in made[made.rindex(" / "):]


def test_rows_of_a_question_that_wants_very_many_are_not_held(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from satchel.operators import dense

    monkeypatch.setattr(dense, "HELD", 5)
    vectors, rng = np.array([[1.0, 0.0], [0.6, 0.8]], dtype=np.float32), np.random.default_rng(3)
    leaders = dense._Leaders(["few", "many"], vectors, [3, 1000])
    given, told = [], []
    for part in range(4):
        rows = rng.integers(-2, 3, (50, 2)).astype(np.float32)
        ids = [f"{(part * 50 + i) * 7 % 200:03d}" for i in range(50)]
        given += list(zip(ids, rows))
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(["p"] * 50), pa.array(rows.tolist(), pa.list_(pa.float32()))], names=["id", "project_id", "embedding"])
        told += [r for b in leaders.offer(batch) for r in b.to_pylist()]
    assert len(told) == 200 and {r["query_id"] for r in told} == {"many"} and len(leaders.best[1][0]) == 0
    unit = [(i, v.astype(np.float64) / (np.linalg.norm(v.astype(np.float64)) or 1)) for i, v in given]
    asked = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    exact = lambda q: sorted((-round(float(u @ asked[q]), 6), i) for i, u in unit)
    assert sorted((-round(r["score"], 6), r["id"]) for r in told) == exact(1)
    assert [(-round(r["score"], 6), r["id"]) for b in leaders.rows() for r in b.to_pylist()] == exact(0)[:3]
