"""What runs keep, tell and spend: versions of a path, events, usage, resumed migrations, failing rerankers."""

import uuid

import pytest
from pyspark.sql import functions as F

from satchel.operators.embedding import hash_embed
from satchel.operators.rerank import apply_hits, hits_of, rerank_calls
from satchel.operators.usage import read_usage
from satchel.plans.migrate import _repeated, _taken, migrate, reembedded
from satchel.plans.search import embed_queries, search
from satchel.plans.sync import index_documents, sync
from satchel.session import scratch_root
from satchel.sources.store import PointStore

FILE = "project_id string, source_dir string, rel_path string, length long, text string"
DOCUMENT = "id string, content string, meta map<string,string>"


def events_of(spark, log):
    return spark.read.parquet(log).orderBy("ts").collect()


def test_one_text_of_a_path_is_stored_whole(spark, tmp_path):
    old, new = "a" * 3200, "b" * 1700
    rows = [("p", "d", "x.md", 3200, old), ("p", "d", "x.md", 1700, new), ("p", "d", "x.md", None, None), ("p", "d", "y.md", 2, "yy"), ("p", "d", "y.md", 2, "yy")]
    store = PointStore(spark, str(tmp_path / "s"), buckets=2)
    logs = {"events": str(tmp_path / "events"), "usage": str(tmp_path / "usage")}
    report = sync(store, spark.createDataFrame(rows, FILE).repartition(5), **logs).first()
    assert (report["indexed"], report["files_scanned"]) == (3, 2)
    kept = {r.id: r.content.rstrip("\n").split("\n")[-1] for r in store.points().collect()}
    assert kept == {"d/x.md#chunk0": "b" * 1500, "d/x.md#chunk1": "b" * 200, "d/y.md#chunk0": "yy"}
    told = [(r.type, r.project_id, r.data.get("indexed")) for r in events_of(spark, logs["events"])]
    assert told == [("index_started", "p", None), ("index_completed", "p", "3")]
    spent = read_usage(spark, logs["usage"]).collect()
    assert [(r.stage, r.tokens) for r in spent] == [("embed", 3 * 4)]


def test_failed_sync_is_told(spark, tmp_path):
    def broken(rows):
        raise RuntimeError("no model")

    log = str(tmp_path / "events")
    with pytest.raises(RuntimeError):
        sync(PointStore(spark, str(tmp_path / "s"), buckets=1), spark.createDataFrame([("p", "d", "x.md", 1, "x")], FILE), embed=broken, events=log)
    assert [r.type for r in events_of(spark, log)] == ["index_started", "index_failed"]


def pages(spark, n):
    return spark.createDataFrame([(f"d{i}", f"text {i}", {}) for i in range(n)] + [("d0", "last of d0", {})], DOCUMENT)


def test_migration_is_taken_up_again(spark, tmp_path):
    store, log, usage = PointStore(spark, str(tmp_path / "s"), buckets=1), str(tmp_path / "e"), str(tmp_path / "u")
    calls = []

    def flaky(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("no model")
        return hash_embed(rows)

    run = {"documents": pages(spark, 30).coalesce(1), "embed": flaky, "rounds": 3, "run_id": "r1", "events": log, "usage": usage, "batch": 4}
    with pytest.raises(RuntimeError):
        migrate(store, "moved", **run)
    kinds = [r.type for r in events_of(spark, log)]
    assert kinds[0] == "migration_started" and kinds[-1] == "migration_failed" and 0 < store.points().count() < 30
    done = migrate(store, "moved", **run)
    assert (done.written, done.run_id, len(calls)) == (31, "r1", 4)
    assert {r.id: r.content for r in store.points().collect()} == {"d0": "last of d0", **{f"d{i}": f"text {i}" for i in range(1, 30)}}
    told = spark.read.parquet(log).where("type = 'migration_progress' AND data['round'] IS NULL")
    want = [(r.done, r.percent) for r in done.progress.orderBy("seq").collect()]
    assert sorted((int(r.data["done"]), int(r.data["percent"])) for r in told.collect()) == want
    kinds = [r.type for r in events_of(spark, log)]
    assert kinds.count("migration_started") == kinds.count("migration_completed") == 1
    assert len(read_usage(spark, usage).collect()) == 3


def test_last_of_repeated_ids_follows_the_order_given(spark, tmp_path):
    """Rows of one id in files of very different size keep their order."""
    rows = spark.createDataFrame([("a", "x" * 200_000, {}), ("a", "second", {}), ("a", "third", {})], DOCUMENT).coalesce(1)
    store = PointStore(spark, str(tmp_path / "s"), buckets=1)
    migrate(store, "m", documents=rows)
    assert store.points().first()["content"] == "third"


def test_rerankers_that_fail_or_point_nowhere(spark, tmp_path):
    store = PointStore(spark, str(tmp_path / "s"), buckets=1)
    index_documents(store, spark.createDataFrame([(f"d{i}", f"word {i}", {}) for i in range(6)], DOCUMENT), "p")
    asked = embed_queries(spark.createDataFrame([(q, "p", q) for q in ("word", "fails", "nowhere")], "query_id string, project_id string, query string"))

    def scorer(question, texts, k):
        if question == "fails":
            raise KeyError("down")
        return [(n + (100 if question == "nowhere" else 0), 1.0 - n / 10) for n in range(2)], 10

    usage = str(tmp_path / "usage")
    answer = search(asked, store.points(), scorer=scorer, counts_tokens=True, usage=usage)
    counts = {r.query_id: (r.reranked, r.results) for r in answer.composition().collect()}
    assert counts == {"word": (True, 2), "fails": (False, 5), "nowhere": (True, 0)}
    assert {r.query_id: r.error for r in answer.calls.where("error IS NOT NULL").collect()} == {"fails": "KeyError: 'down'"}
    assert [(r.stage, r.tokens) for r in read_usage(spark, usage).collect()] == [("rerank", 20)]


def test_hits_of_calls(spark):
    rows = spark.createDataFrame([("q", "a", 1, "x", 0.5, "?", 3), ("q", "b", 2, "y", 0.4, "?", 3)], "query_id string, id string, rank int, content string, score double, query string, k int")
    calls = rerank_calls(rows, lambda question, texts, k: [(1, 9.0), (7, 1.0), (0, 0.5)])
    assert [(r.id, r.rank, r.score) for r in apply_hits(rows, hits_of(calls)).orderBy("rank").collect()] == [("b", 1, 9.0), ("a", 2, 0.5)]


def test_migration_moves_only_the_rows_of_repeated_ids(spark, tmp_path):
    rows = [("a", "one", {"content": "one", "k": "1"}, 1), (None, "no id", None, 2), (None, "no id, last", {}, 3), ("b", "two", {"k": "two"}, 4), ("b", "last", {"k": "last", "j": None}, 5), ("c", None, {"n": None}, 6)]
    docs = spark.createDataFrame(rows, "id string, content string, meta map<string,string>, ordinal long")
    run = uuid.uuid4().hex
    kept = [(r.id, r.content, r.meta) for r in _taken(docs.coalesce(1), run).orderBy("ordinal").collect()]
    assert kept == [r[:3] for r in rows]
    # A text that the metadata repeats is written once.
    assert spark.read.parquet(f"{scratch_root(spark)}/migration-{run}").where("id = 'a'").first().meta == {"k": "1"}
    shown = lambda df: sorted(((r.id, r.content, r.meta, r.embedding) for r in df.collect()), key=repr)
    known = _repeated(docs)
    assert {r.id for r in known.collect()} == {None, "b"}
    assert shown(reembedded(docs, "p", repeated=known)) == shown(reembedded(docs, "p"))
