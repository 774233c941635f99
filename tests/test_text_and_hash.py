"""Chunking, hashing, identifiers, paths, metadata."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from satchel.functions import hashing, meta, paths, text, vectors
from workload.base import Tables
from workload.projections import collection_names
from workload.scalars import tokens as tokens_of_documents


def chunked(value: str, limit: int) -> list[str]:
    """The chunking rule in plain Python."""
    if len(value) <= limit:
        return [value]
    out, cur = [], ""
    for row in value.split("\n"):
        if len(row) > limit:
            if cur:
                out.append(cur)
                cur = ""
            while len(row) > limit:
                out.append(row[:limit])
                row = row[limit:]
        if cur and len(cur) + len(row) + 1 > limit:
            out.append(cur)
            cur = ""
        cur += row + "\n"
    return out + ([cur] if cur else [])


def column(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("limit", [1, 7, 20, 50])
def test_chunks_follow_the_rule(spark, limit):
    rng = random.Random(limit)
    texts = ["x" * limit, "x" * (limit + 1), "x" * (3 * limit), "a\nb", "ab\n" * limit, "\n" * (limit + 3), "é" * (2 * limit + 1)]
    texts += ["ab\n" + "y" * (2 * limit + 5) + "\ncd\n", "\n".join(["z" * limit] * 3)]
    for _ in range(60):
        texts.append("".join(rng.choice("ab \n\nçö") for _ in range(rng.randint(0, 120))))
    got = column(spark, texts).select("v", text.chunk_text(F.col("v"), limit).alias("c")).collect()
    for row in got:
        assert row["c"] == chunked(row["v"], limit), repr(row["v"])


def test_content_hash_known_values(spark):
    values = ["hello", "", "hello world", "naïve ✓"]
    for row in column(spark, values).select("v", hashing.content_hash(F.col("v")).alias("h")).collect():
        assert row["h"] == hashlib.sha256(row["v"].encode()).hexdigest()[:16]
    assert hashlib.sha256(b"hello").hexdigest()[:16] == "2cf24dba5fb0a30e"


def test_point_uuid_equals_name_based_uuid(spark):
    values = ["a", "src/pkg/file.go#chunk0", "é✓", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"] + [str(i) for i in range(200)]
    for row in column(spark, values).select("v", hashing.point_uuid(F.col("v")).alias("u")).collect():
        same = len(row["v"]) == 36
        assert row["u"] == (row["v"] if same else str(uuid.uuid5(uuid.NAMESPACE_URL, row["v"])))


def test_document_ids(spark):
    rows = column(spark, ["text one"])
    got = rows.select(
        hashing.document_id(F.lit("given"), F.col("v")).alias("a"),
        hashing.document_id(F.lit(""), F.col("v"), "hex").alias("b"),
        hashing.document_id(F.lit(None).cast("string"), F.col("v")).alias("c"),
        hashing.document_id(F.lit(""), F.col("v"), "random").alias("d"),
    ).first()
    assert got["a"] == "given" and got["b"] == b"text one".hex()
    assert got["c"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "text one")) and uuid.UUID(got["d"])
    with pytest.raises(ValueError):
        hashing.document_id(F.col("v"), F.col("v"), "other")


def test_collection_names(spark):
    values = ["my-app_1", "a b/c", "!!!", "project_x"]
    got = [r["n"] for r in column(spark, values).select(hashing.collection_name(F.col("v")).alias("n")).collect()]
    assert got[:2] == ["project_my-app_1", "project_abc"]
    assert got[2] == "project_" + hashlib.sha256(b"!!!").hexdigest()[:16]
    back = column(spark, ["project_alpha", "project_beta", "internal"]).select(hashing.project_of_collection(F.col("v")).alias("p"))
    assert [r["p"] for r in back.collect()] == ["alpha", "beta", None]


def test_indexable_names(spark):
    yes = ["a.go", "b.TSX", ".env", "prod.env", ".gitignore", "Makefile", "LICENSE", "Dockerfile", "x.dockerfile", "q.gql", "_x.py"]
    no = ["a.png", "a", "go", "a.go.bak", "makefile2", "x.", "archive.tar.gz"]
    for row in column(spark, yes + no).select("v", paths.is_indexable(F.col("v")).alias("ok")).collect():
        assert row["ok"] == (row["v"] in yes), row["v"]


def test_skipped_directories(spark):
    keep = ["a.go", "src/a.go", "src/builder/a.go", "build.go", "x/dist.txt"]
    drop = ["node_modules/a.js", "x/.git/config.txt", "a/b/vendor/c.go", "target/x.rs", ".pytest_cache/a.md"]
    for row in column(spark, keep + drop).select("v", paths.outside_skipped_dirs(F.col("v")).alias("ok")).collect():
        assert row["ok"] == (row["v"] in keep), row["v"]


def test_highlight(spark):
    rows = spark.createDataFrame(
        [("Hash the HASH a", "hash a"), ("nothing", "x y"), ("a+b a.b", "a+b"), ("Ñandú", "ñandú"), ("text", "  ")], "c string, q string"
    )
    got = [r["h"] for r in rows.select(text.highlight(F.col("c"), F.col("q")).alias("h")).collect()]
    assert got == [
        "<mark>Hash</mark> the <mark>HASH</mark> a", "nothing", "<mark>a+b</mark> a.b", "<mark>Ñandú</mark>", "text",
    ]


def test_merge_keeps_the_callers_entries(spark):
    row = spark.range(1).select(
        meta.merge_caller_wins(meta.provenance("voyage-4", F.lit(3)), F.create_map(F.lit("embed_dim"), F.lit("9"), F.lit("k"), F.lit("v"))).alias("m"),
        meta.merge_caller_wins(meta.provenance(None, F.lit(3)), F.lit(None).cast("map<string,string>")).alias("n"),
    ).first()
    assert row["m"] == {"embed_model": "voyage-4", "embed_dim": "9", "k": "v"}
    assert row["n"] == {"embed_model": "unknown", "embed_dim": "3"}


def test_only_string_entries_survive(spark):
    payload = '{"a": "x", "n": 1, "b": true, "z": null, "l": ["s"], "o": {"k": "v"}, "e": ""}'
    got = column(spark, [payload]).select(meta.string_entries_of_json(F.col("v")).alias("m")).first()
    assert got["m"] == {"a": "x", "e": ""}


def test_zero_vectors_and_dimensions(spark):
    row = spark.range(1).select(
        vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("zero"),
        vectors.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(4.0))).alias("one"),
        vectors.dimension(F.lit(None).cast("array<float>")).alias("none"),
        vectors.truncate_dim(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2).alias("cut"),
    ).first()
    assert row["zero"] == 0 and row["one"] == 1 and row["none"] == 384
    assert [round(x, 6) for x in row["cut"]] == [0.6, 0.8]


def test_three_decimals_round_the_binary_value(spark):
    rng = random.Random(2)
    values = [i / 16 for i in range(-40, 40)] + [i / 80 for i in range(-160, 160)] + [i / 2000 for i in range(-2500, 2500)]
    values += [rng.uniform(-2, 2) for _ in range(2000)] + [1 / 61 + 1 / (61 + i) for i in range(100)] + [0.0, -0.0001, 1e-9, 490.02]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for row in df.select("x", text.three_decimals(F.col("x")).alias("s")).collect():
        assert row["s"] == "%.3f" % row["x"], row["x"]


def test_names_of_dealt_out_pages(spark, tmp_path):
    """The long odd names of neighbouring pages are not left to one task."""
    rows = [(n, f"http://h/{n}?\u00e9_-\u0660") for n in range(50)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    made = collection_names(Tables(spark, str(tmp_path)))
    assert made.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {r["page_id"]: r["name"] for r in made.collect()}
    for n, _ in rows:
        assert got[n] == f"project_httph{n}_-"
        assert got[-1 - n] == "project_" + hashlib.sha256(("!" + "?" * (n + 1)).encode()).hexdigest()[:16]


def test_texts_not_words_are_dealt_out(spark, tmp_path):
    rows = [(1, "a b a"), (1, "b c"), (None, "a"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counted = tokens_of_documents(Tables(spark, str(tmp_path)))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "word" in line for line in plan.splitlines())
    got = {(r["doc_id"], r["word"]): (r["tf"], r["first_at"]) for r in counted.collect()}
    assert got == {(1, "a"): (2, 0), (1, "b"): (2, 0), (1, "c"): (1, 1), (None, "a"): (1, 0)}
