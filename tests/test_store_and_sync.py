"""Files, sync, keyed writes, imports, migration."""

import json
import os

import pytest
from pyspark.sql import functions as F

from satchel.operators.keyed import last_wins
from satchel.operators.points import export_documents, list_points
from satchel.plans.migrate import migrate
from satchel.plans.sync import index_documents, sync
from satchel.sources.files import _TreeReader, list_tree, read_files
from satchel.sources.imports import distances, import_documents, parallel_array_pages
from satchel.sources.store import PointStore
from satchel.streaming.sync import apply_changes


@pytest.fixture
def store(spark, tmp_path):
    return PointStore(spark, str(tmp_path / "store"), buckets=2, with_postings=True)


def put(root, **files):
    for name, value in files.items():
        write(root, name, value)


def write(root, path, value):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as handle:
        handle.write(value if isinstance(value, bytes) else value.encode())


def totals(report):
    row = report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("indexed", "skipped", "deleted", "files_scanned")]).first()
    return tuple(row)


def ids(store, project="p"):
    return sorted(r["id"] for r in store.points([project]).select("id").collect())


def test_tree_listing(spark, tmp_path):
    root = str(tmp_path / "build")
    for path in (".env", ".gitignore", "_x.py", "Makefile", "a/b/c/deep.go", ".hidden/x.md", "empty.txt"):
        write(root, path, "" if path == "empty.txt" else "text")
    for path in ("node_modules/a.js", "a/.git/config.txt", "a/b/vendor/x.go", "pic.png", "noext"):
        write(root, path, "text")
    write(root, "big.txt", b"x" * 512_001)
    write(root, "limit.txt", b"x" * 512_000)
    write(root, "latin.txt", b"caf\xe9")
    listed = {r["rel_path"]: r["length"] for r in list_tree(spark, root).collect()}
    assert set(listed) == {
        ".env", ".gitignore", "_x.py", "Makefile", "a/b/c/deep.go", ".hidden/x.md", "empty.txt", "big.txt", "limit.txt", "latin.txt",
    }
    files = {r["rel_path"]: r for r in read_files(spark, root, "p").collect()}
    assert files["empty.txt"]["text"] is None and files["big.txt"]["text"] is None
    assert len(files["limit.txt"]["text"]) == 512_000 and files["latin.txt"]["text"] == "caf�"
    assert files[".env"]["source_dir"] == "build"


def test_missing_tree_is_empty(spark, tmp_path):
    assert list_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_many_folders_are_dealt_into_few_shares(spark, tmp_path):
    for n in range(40):
        (tmp_path / "a" / f"d{n}").mkdir(parents=True)
        (tmp_path / "a" / f"d{n}" / ".env").write_text("x" * (n + 1))
    parts = _TreeReader(str(tmp_path), 8).partitions()
    assert len(parts) <= 2 * 8
    rows = [r for p in parts for r in _TreeReader(str(tmp_path), 8).read(p)]
    assert sorted(r[2] for r in rows) == list(range(1, 41))


def test_sync_life(spark, tmp_path, store):
    root = str(tmp_path / "src")
    put(root, **{"test.go": "package main\n", "sub/a.go": "same", "b.go": "same", "empty.md": ""})
    scan = lambda: read_files(spark, root, "p")
    assert totals(sync(store, scan(), model="m")) == (3, 0, 0, 4)
    assert totals(sync(store, scan(), model="m")) == (0, 3, 0, 4)
    write(root, "test.go", "package main\n\nfunc newFunc() {}\n")
    os.remove(os.path.join(root, "b.go"))
    assert totals(sync(store, scan(), model="m")) == (1, 1, 1, 3)
    assert ids(store) == ["src/sub/a.go#chunk0", "src/test.go#chunk0"]
    row = store.points().where("source_file = 'test.go'").first()
    assert row["content"] == "File: test.go\n\npackage main\n\nfunc newFunc() {}\n"
    assert (row["embed_model"], row["embed_dim"], row["chunk_version"]) == ("m", 64, "v2")
    # Postings follow the texts of the latest version.
    assert store.postings().where("term = 'newfunc'").count() == 1


def test_second_directory_is_left_alone(spark, tmp_path, store):
    put(str(tmp_path / "one"), **{"a.go": "a"})
    put(str(tmp_path / "two"), **{"b.go": "b"})
    sync(store, read_files(spark, str(tmp_path / "one"), "p"))
    assert totals(sync(store, read_files(spark, str(tmp_path / "two"), "p"))) == (1, 0, 0, 1)
    assert ids(store) == ["one/a.go#chunk0", "two/b.go#chunk0"]


def test_emptied_and_shrunk_files(spark, tmp_path, store):
    root = str(tmp_path / "src")
    put(root, **{"a.txt": "line one\n" * 400, "b.txt": "text"})
    sync(store, read_files(spark, root, "p"))
    before = len(ids(store))
    assert before == 4
    # An emptied file is still present, so its chunks stay.
    write(root, "b.txt", "")
    assert totals(sync(store, read_files(spark, root, "p")))[2] == 0
    # The tail of a shrunk file stays unless asked for.
    write(root, "a.txt", "short")
    assert totals(sync(store, read_files(spark, root, "p")))[:3] == (1, 0, 0)
    assert len(ids(store)) == before
    assert totals(sync(store, read_files(spark, root, "p"), prune_tail=True))[:3] == (0, 1, 2)
    assert ids(store) == ["src/a.txt#chunk0", "src/b.txt#chunk0"]


def docs(spark, *rows):
    return spark.createDataFrame(rows, "id string, content string, meta map<string,string>")


def test_same_id_in_two_projects(spark, store):
    index_documents(store, docs(spark, ("shared", "content for project A", {})), "A")
    index_documents(store, docs(spark, ("shared", "content for project B", {})), "B")
    index_documents(store, docs(spark, ("shared", "updated content", {"type": "howto"})), "A")
    got = {r["project_id"]: r["content"] for r in store.points().collect()}
    assert got == {"A": "updated content", "B": "content for project B"}
    store.delete_points(spark.createDataFrame([("A", "shared")], "project_id string, id string"))
    assert [r["project_id"] for r in store.points().collect()] == ["B"]
    # Emptied, not dropped: the project is still known.
    assert {r["project_id"] for r in store.projects().collect()} == {"A", "B"}
    before = store.version()
    store.delete_points(spark.createDataFrame([], "project_id string, id string"))
    assert store.version() == before
    store.delete_project("A")
    assert {r["project_id"] for r in store.projects().collect()} == {"B"}


def test_last_document_of_a_call_wins(spark, store):
    rows = docs(spark, ("x", "first", {}), ("x", "second", {"k": "v"}), ("y", "only", None)).coalesce(1)
    assert index_documents(store, rows, "p") == 3
    got = {r["id"]: (r["content"], r["meta"].get("k")) for r in store.points().collect()}
    assert got == {"x": ("second", "v"), "y": ("only", None)}
    assert last_wins(spark.createDataFrame([("p", "a", 1, "o"), ("p", "a", 2, "n")], "project_id string, id string, ordinal int, c string")).first()["c"] == "n"


def test_export_and_listing(spark, store):
    long = "x" * 500
    index_documents(store, docs(spark, ("uuid-1", long, {"doc_id": "file.go#chunk0", "source_file": "file.go", "own": "1"})), "p")
    row = export_documents(store.points(["p"])).first()
    assert row["id"] == "file.go#chunk0" and row["content"] == long
    assert row["meta"] == {"doc_id": "file.go#chunk0", "source_file": "file.go", "own": "1", "embed_model": "unknown", "embed_dim": "64"}
    shown = list_points(store.points(["p"])).first()
    assert (len(shown["content"]), shown["chunk_index"], shown["id"]) == (200, "", "uuid-1")
    plan = list_points(store.points(["p"]))._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema:")[1]


def test_vacuum_keeps_what_is_live(spark, store):
    for n in range(3):
        index_documents(store, docs(spark, (f"d{n}", "t", {}), ("same", f"v{n}", {})), "p")
    before = sorted(map(str, store.points().collect()))
    store.vacuum()
    assert sorted(map(str, store.points().collect())) == before
    assert store.points().count() == 4


def pages(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "page string")


def listed(df):
    return sorted((r["id"], r["content"], tuple(sorted(r["meta"].items()))) for r in df.collect())


def as_page(**fields):
    return json.dumps(fields)


def test_import_layouts(spark):
    fetched = as_page(vectors={
        "p-10": {"id": "p-10", "metadata": {"content": "red kite", "source_file": "birds/kite.md"}},
        "p-11": {"id": "p-11", "metadata": {"content": "barn owl", "weight": 0.4}},
    })
    ids_only = [as_page(vectors=[{"id": "p-11"}], pagination={"next": "more"}), as_page(vectors=[{"id": "p-10"}, {"id": "p-99"}], pagination={})]
    got = import_documents(pages(spark, fetched), "vectors", listed=pages(spark, *ids_only))
    assert listed(got) == [
        ("p-10", "red kite", (("content", "red kite"), ("source_file", "birds/kite.md"))), ("p-11", "barn owl", (("content", "barn owl"),)),
    ]
    found = {"body": "tawny", "source_file": "birds/owl.md", "_additional": {"id": "w7"}}
    nested = import_documents(pages(spark, as_page(data={"Get": {"Bird": [found]}})), "nested", "body")
    assert listed(nested) == [("w7", "tawny", (("body", "tawny"), ("source_file", "birds/owl.md")))]
    one = pages(spark, as_page(ids=[["k5"]], documents=[["a wren"]], metadatas=[[{"doc_id": "birds-5"}]]))
    assert listed(import_documents(one, "arrays")) == [("k5", "a wren", (("doc_id", "birds-5"),))]
    assert listed(parallel_array_pages(one, stored=True))[0][0] == "birds-5"
    uneven = pages(spark, as_page(ids=[["k1", "k2", "k3"], ["k4"]], documents=[["first"], []], metadatas=[[{"y": "2"}, {"content": "in the map"}]]))
    assert [(i, c) for i, c, _ in listed(import_documents(uneven, "arrays"))] == [("k1", "first"), ("k2", "in the map"), ("k3", ""), ("k4", "")]
    points = [{"id": 412, "payload": {"content": "by number"}}, {"id": "f00", "payload": {"content": "by own id", "doc_id": "nest.md#chunk3"}}]
    scrolled = import_documents(pages(spark, as_page(result={"points": points, "next_page_offset": 413})), "pages")
    assert [(i, c) for i, c, _ in listed(scrolled)] == [("412", "by number"), ("nest.md#chunk3", "by own id")]
    with pytest.raises(ValueError):
        import_documents(one, "other")


def test_distances_become_scores(spark):
    page = as_page(
        ids=[["far", "near", "opposite"]], distances=[[0.75, 0.02, 2.0]], documents=[["x", "y", "z"]], metadatas=[[{"source_file": "x.md"}, {}, {}]]
    )
    assert {r["id"]: round(r["score"], 9) for r in distances(pages(spark, page)).collect()} == {"far": 0.25, "near": 0.98, "opposite": -1.0}


def test_store_remembers_its_settings(spark, tmp_path):
    root = str(tmp_path / "kept")
    rows = docs(spark, *[(f"d{i}", f"text {i}", {}) for i in range(40)])
    index_documents(PointStore(spark, root, buckets=16, with_postings=True), rows, "p")
    again = PointStore(spark, root)
    assert (again.buckets, again.with_postings) == (16, True)
    for wrong in ({"buckets": 8}, {"with_postings": False}):
        with pytest.raises(ValueError):
            PointStore(spark, root, **wrong)
    index_documents(again, rows.withColumn("content", F.concat("content", F.lit("!"))), "p")
    assert again.points().count() == 40 and again.postings().select("id").distinct().count() == 40
    again.delete_points(again.points())
    assert again.points().count() == 0


def test_keys_stay_unique(spark, store):
    one = docs(spark, ("a", "first", {}), ("b", "only", {}))
    index_documents(store, one, "p")
    twice = store.points().drop("project_key", "bucket")
    store.upsert(twice.unionByName(twice.withColumn("content", F.concat(F.lit("z"), "content"))))
    assert sorted((r["id"], r["content"]) for r in store.points().select("id", "content").collect()) == [("a", "zfirst"), ("b", "zonly")]
    store.insert(twice.unionByName(twice.withColumn("id", F.lit("c")).limit(1)))
    assert sorted((r["id"], r["content"]) for r in store.points().select("id", "content").collect())[:2] == [("a", "zfirst"), ("b", "zonly")]
    assert store.points().count() == 3


def test_migration(spark, store, tmp_path):
    rows = docs(spark, *[(f"d{i}", "text", {"content_hash": "h"}) for i in range(150)])
    run = migrate(store, "dest", documents=rows, model="new")
    assert run.written == 150 and store.points(["dest"]).where("content_hash = 'h' AND embed_model = 'new'").count() == 150
    assert [tuple(r) for r in run.progress.select("done", "total", "percent").orderBy("done").collect()] == [
        (0, 150, 0), (64, 150, 42), (128, 150, 85), (150, 150, 100),
    ]
    other = PointStore(spark, str(tmp_path / "other"), buckets=1)
    assert migrate(other, "copy", source=store, source_project="dest").written == 150
    # Stored provenance belongs to the caller's metadata and travels along.
    assert other.points(["copy"]).where("embed_model = 'new'").count() == 150
    with pytest.raises(ValueError):
        migrate(store, "dest", source=store, source_project="dest")
    with pytest.raises(ValueError):
        migrate(store, "dest")


def test_change_batches(spark, store):
    def change(*rows):
        return spark.createDataFrame(rows, "project_id string, source_dir string, rel_path string, length long, text string, deleted boolean")

    first = change(("p", "s", "a.go", 1, "a", False), ("p", "s", "b.go", 1, "b", False))
    apply_changes(store, first)
    version = store.version()
    apply_changes(store, first)
    assert store.version() == version
    apply_changes(store, change(("p", "s", "a.go", 0, None, True), ("p", "s", "c.go", 1, "c", False)))
    assert ids(store) == ["s/b.go#chunk0", "s/c.go#chunk0"]


def test_an_empty_store_is_not_joined_with(spark, store):
    """Planned as nothing, so a first sync does not shuffle its texts for it."""
    assert "LocalTableScan" in store.points()._jdf.queryExecution().executedPlan().toString()


def test_rewritten_partitions_move_once(spark, store, monkeypatch):
    """Replaced, deleted, added and untouched keys, with many slices."""
    from satchel.sources import store as module

    monkeypatch.setattr(module, "SLICE_ROWS", 2)
    index_documents(store, spark.createDataFrame([(str(n), f"old {n}", {}) for n in range(30)], "id string, content string, meta map<string,string>"), "p")
    old = store.points()
    fresh = old.where("id < '2'").withColumn("content", F.lit("new"))
    gone = old.where("id >= '5'").select("project_id", "project_key", "bucket", "id")
    left = store._replaced(old, fresh, gone)
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {str(n): "new" if str(n) < "2" else f"old {n}" for n in range(30) if str(n) < "5"}
    assert {r["id"]: r["content"] for r in left.collect()} == want and left.count() == len(want)


def test_small_splits_are_set_for_a_while_and_never_raised(spark):
    from satchel.session import small_splits

    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(KeyError), small_splits(spark, 1 << 20):
        assert [spark.conf.get(n) for n in names] == [str(1 << 20), str(1 << 14)]
        raise KeyError
    with small_splits(spark, 1 << 40):
        assert [spark.conf.get(n) for n in names] == before
    assert [spark.conf.get(n) for n in names] == before


def test_a_stream_leaves_the_store_and_no_copies(spark, tmp_path):
    """Of each batch only the store's last version stays; unchanged chunks are not embedded again."""
    from satchel.operators.embedding import hash_embed
    from satchel.session import scratch_root
    from satchel.streaming.sync import continuous_sync

    columns = "project_id string, source_dir string, rel_path string, length long, text string, deleted boolean"
    old = [("p", "d", f"f{i}.txt", 9, f"text of {i}", False) for i in range(6)]
    new = [old[0], ("p", "d", "f1.txt", 9, "other text", False), (*old[2][:5], True)]
    twice = [("p", "d", "f3.txt", 9, "a", False), ("p", "d", "f3.txt", 9, "b", False)]
    path, seen = str(tmp_path / "in"), spark.sparkContext.accumulator(0)

    def counted(df):
        one = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
        return hash_embed(df.withColumn("content", one("content")))

    store = PointStore(spark, str(tmp_path / "store"), buckets=2)
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    for some, embedded in ((old, 6), (new, 1), (twice, 1)):
        spark.createDataFrame(some, columns).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(path)
        seen.value = 0
        continuous_sync(stream, store, str(tmp_path / "ck"), embed=counted, once=True, keep=1).awaitTermination()
        assert seen.value == embedded
    got = {(r["source_file"], r["content"].split("\n")[-1]) for r in store.points().collect()}
    assert got == {("f0.txt", "text of 0"), ("f1.txt", "other text"), ("f3.txt", "b"), ("f4.txt", "text of 4"), ("f5.txt", "text of 5")}
    left = [f for f in set(os.listdir(root)) - before if f.startswith(("changes", "stream"))]
    assert left == [] and store.version() == 3 and os.listdir(str(tmp_path / "store" / "live")) == ["v=3"]
