"""Percentiles, pages, positions, reports, streaming state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from satchel.operators import percentile, reports
from satchel.operators.percentile import percentiles
from satchel.operators.ranking import batches_of, best_per_group, latest, page, page_after, with_position
from satchel.streaming import events, metrics
from workload.base import Tables
from workload.streams import streamed

START = datetime(2024, 1, 1)


def log(spark, values, group=None):
    rows = [(i, START + timedelta(seconds=i), group(i) if group else "p", float(v), True, False, i % 7, 5, 1, 2, 0) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows,
        "event_id long, ts timestamp, project_id string, latency_ms double, hybrid boolean, reranked boolean, candidates int, "
        "results int, dense_count int, lexical_count int, rerank_moved int",
    )


def rank_rule(values, p):
    values = sorted(values)
    return values[int(p * (len(values) - 1) + 0.5)]


def test_known_latencies(spark):
    row = reports.latency_summary(log(spark, [7, 310, 2, 45, 45, 18, 90])).first()
    assert (row[0], round(row[1], 6), *row[2:]) == (7, 73.857143, 45.0, 310.0)


def test_empty_log(spark):
    assert tuple(reports.latency_summary(log(spark, [1]).where("false")).first()) == (0, 0.0, 0.0, 0.0)
    assert reports.last_query(log(spark, [1]).where("false")).count() == 0


def test_recent_512(spark):
    slow = [(i * 37) % 1009 / 4 for i in range(795)]
    row = reports.recent_latency_summary(log(spark, slow)).first()
    kept = slow[-512:]
    assert tuple(row) == (795, pytest.approx(sum(kept) / 512), rank_rule(kept, 0.5), rank_rule(kept, 0.95))


@pytest.mark.parametrize("n, ordered, accuracy, steps", [(1, 9, 99, 9), (2, 1, 99, 9), (3, 1, 99, 9), (12, 4, 99, 9), (400, 100_000, 99, 9), (400, 5, 10_000, 100), (400, 7, 20, 4)])
def test_percentiles_equal_sorting(spark, monkeypatch, n, ordered, accuracy, steps):
    """Also with a coarse sketch, skewed values, one hot group and few values in order at a time."""
    monkeypatch.setattr(percentile, "ORDERED", ordered)
    monkeypatch.setattr(percentile, "ACCURACY", accuracy)
    monkeypatch.setattr(percentile, "STEPS", steps)
    rng = random.Random(n)
    values = [rng.choice([0.0, 5.0, rng.expovariate(0.1), -rng.random(), float("inf")]) for _ in range(n)]
    group = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])) for _ in range(n)]
    df = log(spark, values, lambda i: group[i]).repartition(5)
    wanted = [("low", 0.0), ("mid", 0.5), ("high", 0.95), ("top", 1.0)]
    row = percentiles(df, "latency_ms", wanted).first()
    assert [row[name] for name, _ in wanted] == [rank_rule(values, p) for _, p in wanted]
    for row in percentiles(df, "latency_ms", wanted, ["project_id"]).collect():
        mine = [v for v, g in zip(values, group) if g == row["project_id"]]
        assert row["n"] == len(mine)
        assert [row[name] for name, _ in wanted] == [rank_rule(mine, p) for _, p in wanted]


def test_positions_are_global(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x")).repartition(6)
    got = with_position(df, [F.col("x").asc()]).collect()
    assert all(r["x"] == r["position"] for r in got) and len(got) == 1000
    assert {r["batch"] for r in batches_of(df, [F.col("x").asc()], 64).collect()} == set(range(16))


@pytest.mark.parametrize("offset, limit", [(0, 0), (0, 3), (4, 3), (8, 5), (10, 5), (50, 0), (7, 0), (-3, -1), (None, None), (2, 200_000)])
def test_pages(spark, offset, limit):
    df = spark.range(10).select(F.col("id").alias("x")).repartition(3)
    start, size = max(offset or 0, 0), max(limit or 0, 0)
    expect = list(range(10))[start:]
    expect = expect[:size] if size else expect
    assert [r["x"] for r in page(df, [F.col("x").asc()], offset, limit).collect()] == expect


def test_keyset_pages_cover_everything(spark):
    df = spark.range(700).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("id")).repartition(3)
    seen, last = [], None
    while True:
        rows = [r["id"] for r in page_after(df, "id", last).collect()]
        if not rows:
            break
        seen += rows
        last = rows[-1]
    assert seen == [f"{i:04d}" for i in range(700)]


def test_best_per_group_with_spread(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 10).alias("s"))
    order = [F.col("s").desc(), F.col("id").asc()]
    plain = best_per_group(df, ["g"], order, 7).orderBy("g", "rank").collect()
    spread = best_per_group(df, ["g"], order, 7, spread=8).orderBy("g", "rank").collect()
    assert plain == spread and len(plain) == 14


def test_latest_ties(spark):
    df = spark.createDataFrame([(i, START, "p") for i in range(20)], "event_id long, ts timestamp, project_id string")
    assert [r["event_id"] for r in latest(df, 3).collect()] == [19, 18, 17]


def test_progress_and_throttle(spark):
    totals = spark.createDataFrame([("a", 150), ("b", 0), ("c", 100_000)], "project_id string, total long")
    steps = reports.batch_progress(totals)
    for name, total in (("a", 150), ("b", 0), ("c", 100_000)):
        got = [(r["done"], r["percent"]) for r in steps.where(F.col("project_id") == name).orderBy("seq").collect()]
        expect = [min(i * 64, total) for i in range((total + 63) // 64 + 1)]
        assert got == [(d, d * 100 // total if total else 0) for d in expect]
        kept, last = [], -1
        for d, p in got:
            if p != last:
                kept.append((d, p))
                last = p
        emitted = reports.percent_changes(steps).where(F.col("project_id") == name).orderBy("seq").collect()
        assert [(r["done"], r["percent"]) for r in emitted] == kept


def test_top_files_and_share(spark):
    rows = [("p", f) for f, n in (("a", 4), ("b", 2), ("c", 2), (None, 1)) for _ in range(n)]
    pts = spark.createDataFrame(rows, "project_id string, source_file string")
    got = [(r["file"], r["chunk_count"], r["share"]) for r in reports.top_files(pts, 3).orderBy("rank").collect()]
    assert got == [("a", 4, 1.0), ("b", 2, 0.5), ("c", 2, 0.5)]
    assert reports.distinct_files(pts).first()["files"] == 4


def test_snapshot(spark):
    usage = spark.createDataFrame([("embed", 17), ("embed", 17), ("rerank", 5)], "stage string, tokens long")
    row = reports.metrics_snapshot(log(spark, [10, 20, 30, 40, 100]), usage).first()
    assert (row["query_count"], row["p50_ms"], row["p95_ms"]) == (5, 30.0, 100.0)
    assert (row["tokens_embed"], row["tokens_rerank"], row["tokens_total"]) == (34, 5, 39)
    assert row["last_query"]["candidates"] == 4


def test_event_log_and_activity(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [
        ("index_completed", START, "p", {"indexed": "3", "deleted": "1"}),
        ("query_executed", START + timedelta(1), "p", {"candidates": "40"}),
        ("index_started", START + timedelta(2), "p", {"directory": "/src"}),
        ("project_created", None, "p", {}),
    ]
    df = spark.createDataFrame(rows, "type string, ts timestamp, project_id string, data map<string,string>")
    events.publish(df, path)
    stored = spark.read.parquet(path)
    got = {r["type"]: (r["description"], r["is_ok"]) for r in reports.activity(stored).collect()}
    assert got == {
        "index_completed": ("3 chunks, 1 deleted", True), "query_executed": ("40 candidates", True),
        "index_started": ("/src", False), "project_created": ("p", False),
    }
    assert stored.where("ts IS NULL").count() == 0


def land(df, path, parts):
    df.repartition(parts).write.parquet(path)


def test_streaming_state_equals_batch(spark, tmp_path):
    df = log(spark, range(900), lambda i: "hot" if i % 3 else i % 5)
    path = str(tmp_path / "log")
    land(df, path, 4)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "recent")
    events.keep_recent(source(), out, str(tmp_path / "ck1"), 40, ["project_id"], once=True).awaitTermination()
    kept = events.read_state(spark, out, df.schema).select("project_id", "event_id")
    expect = latest(df, 40, ["project_id"]).select("project_id", "event_id")
    assert kept.exceptAll(expect).count() == 0 and kept.count() == expect.count()
    out = str(tmp_path / "running")
    totals = metrics.running_metrics(source())
    metrics.latest_table(totals, out, str(tmp_path / "ck2"), once=True).awaitTermination()
    got = {r["project_id"]: (r["query_count"], round(r["avg_ms"], 6)) for r in events.read_state(spark, out, totals.schema).collect()}
    batch = df.groupBy("project_id").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("a")).collect()
    assert got == {r["project_id"]: (r["n"], round(r["a"], 6)) for r in batch}


def test_streaming_throttle_and_restart(spark, tmp_path):
    totals = spark.createDataFrame([("a", 15_000), ("b", 70)], "project_id string, total long")
    steps = reports.batch_progress(totals)
    path, out, ck = (str(tmp_path / n) for n in ("progress", "out", "ck"))
    land(steps.where("seq < 50"), path, 2)
    emit = lambda: events.append_to(metrics.percent_throttle(events.follow(spark, path, steps.schema)), out, ck, once=True).awaitTermination()
    emit()
    steps.where("seq >= 50").write.mode("append").parquet(path)
    emit()
    got = spark.read.parquet(out).select("project_id", "percent")
    assert got.count() == got.distinct().count() == reports.percent_changes(steps).count()


def test_batches_do_not_gather_the_rows_in_a_file_each(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    stream = streamed(tables, spark.range(0, 1000, 1, 10), "many-files", batches=2)
    seen = []
    stream.writeStream.foreachBatch(lambda rows, n: seen.append((rows.count(), rows.select(F.input_file_name()).distinct().count()))).option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(n for n, _ in seen) == 1000
    assert all(files == 5 for _, files in seen)
