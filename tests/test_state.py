"""Keyed streaming state against the same answers from tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from satchel.operators import reports
from satchel.operators.ranking import latest
from satchel.streaming import events, metrics, state

START = datetime(2024, 3, 1)
LOG = "event_id long, ts timestamp, project_id string, latency_ms double"


def rows(n, first=0):
    draw = random.Random(n)
    return [(first + i, START + timedelta(seconds=draw.randint(0, 500)), "hot" if i % 3 else draw.choice(["a", "b", None]), i / 8) for i in range(n)]


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_recent_rows_across_a_restart(spark, tmp_path):
    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    everything = []
    for part in range(2):
        some = rows(240, 1000 * part)
        everything += some
        spark.createDataFrame(some, LOG).repartition(2).write.mode("append").parquet(path)
        state.keep_recent_keyed(stream(spark, path, LOG), ck, 12, ["project_id"], once=True).awaitTermination()
        found = state.recent_rows(spark, ck, 12, ["project_id"])
        want = latest(spark.createDataFrame(everything, LOG), 12, ["project_id"]).select(*found.columns)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() == 48
    assert spark.conf.get(state._PROVIDER, "") != state._ROCKSDB
    with pytest.raises(ValueError):
        state.keep_recent_keyed(stream(spark, path, LOG), ck, 12, ["project_id"], ttl_ms=1000, once=True)


def test_percent_steps_in_any_order(spark, tmp_path):
    """Two runs of a project, rows out of order and twice, a restart between."""
    totals = spark.createDataFrame([("p", "m1", 1000), ("p", "m2", 330), ("q", "m1", 0)], "project_id string, migration_id string, total long")
    steps = reports.batch_progress(totals, 10)
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    parts = ["seq % 3 = 2", "seq % 3 = 0 AND seq > 0", "seq % 3 = 2", "seq % 3 = 1 OR seq = 0"]
    for k, part in enumerate(parts):
        steps.where(part).coalesce(1).write.mode("append").parquet(path)
        if k in (1, 3):
            state.follow_percents(stream(spark, path, steps.schema), out, ck, once=True).awaitTermination()
    names = ["project_id", "migration_id", "seq", "done", "total", "percent"]
    got = sorted(tuple(r[n] for n in names) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r[n] for n in names) for r in reports.percent_changes(steps).select(*names).collect())
    assert got == want and len(got) > 100
    held = spark.read.format("statestore").option("stateVarName", "told").load(ck)
    assert held.count() == 0


def test_only_changed_groups_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "COMPACT", 3)
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    columns = LOG + ", candidates int, results int, hybrid boolean, reranked boolean, dense_count int, lexical_count int, rerank_moved int"
    everything = []
    for k in range(8):
        some = [(*r, 4, 3, True, False, 2, 1, 0) for r in rows(30, 100 * k)] if k == 0 else [(100 * k, START, "a", float(k), 4, 3, True, False, 2, 1, 0)]
        everything += some
        spark.createDataFrame(some, columns).coalesce(1).write.mode("append").parquet(path)
    totals = metrics.running_metrics(stream(spark, path, columns))
    state.changed_groups(totals, out, ck, ["project_id"], once=True).awaitTermination()
    found = {r.project_id: (r.query_count, round(r.avg_ms, 9)) for r in state.read_changes(spark, out, totals.schema, ["project_id"]).collect()}
    batch = spark.createDataFrame(everything, columns).groupBy("project_id").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("a")).collect()
    assert found == {r.project_id: (r.n, round(r.a, 9)) for r in batch}
    kept = state._folders(spark, out, "changes")
    assert spark.read.parquet(f"{out}/changes={max(kept)}").count() == 1 and len(kept) <= 5
    assert sorted(state._folders(spark, out, "full")) == [2, 5]


def test_nothing_yet(spark, tmp_path):
    schema = spark.createDataFrame([], LOG).schema
    assert state.read_changes(spark, str(tmp_path / "none"), schema, ["project_id"]).count() == 0
    assert events.read_state(spark, str(tmp_path / "none"), schema).count() == 0


def test_waiting_rows_of_a_run_are_packed(spark, tmp_path):
    totals = spark.createDataFrame([("p", "m1", 1000)], "project_id string, migration_id string, total long")
    steps = reports.batch_progress(totals, 10)
    path, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    steps.where("seq > 0").write.parquet(path)
    state.follow_percents(stream(spark, path, steps.schema), out, ck, once=True).awaitTermination()
    early = spark.read.format("statestore").option("stateVarName", "early").load(ck)
    assert early.count() == 1 and early.select(F.size("list_element.seq")).first()[0] == 100


def test_many_groups_share_a_key_of_the_state(spark, tmp_path, monkeypatch):
    """Also rows that come again, rows without a time, value or project, and a
    batch that is small beside what is kept."""
    monkeypatch.setattr(state, "PARTS", 4)
    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    first = [(i, None if i % 50 == 0 else START + timedelta(seconds=i % 37), None if i % 9 == 0 else f"p{i % 90}", None if i % 7 == 0 else i / 8) for i in range(900)]
    later = [*first[:20], *[(2000 + i, START + timedelta(minutes=1), f"p{i}", 1.0) for i in range(20)]]
    last = [(3000 + i, START + timedelta(minutes=i % 3), f"p{i % 200}", float(i)) for i in range(2000)]
    everything = set()
    for some, blocks in ((first, 1), (later, 2), (last, 1)):
        everything |= set(some)
        spark.createDataFrame(some, LOG).coalesce(1).write.mode("append").parquet(path)
        state.keep_recent_keyed(stream(spark, path, LOG), ck, 5, ["project_id"], once=True).awaitTermination()
        held = spark.read.format("statestore").option("stateVarName", "recent").load(ck)
        assert held.select("key").distinct().count() == 4 and held.groupBy("key").count().agg(F.max("count")).first()[0] == blocks
        found = state.recent_rows(spark, ck, 5, ["project_id"])
        want = latest(spark.createDataFrame(sorted(everything, key=repr), LOG), 5, ["project_id"]).select(*found.columns)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
