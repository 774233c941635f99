"""Times the headline runs and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from satchel.operators import reports  # noqa: E402
from satchel.operators.dense import dense_topk, nearest  # noqa: E402
from satchel.operators.percentile import percentiles  # noqa: E402
from satchel.operators.rerank import term_overlap  # noqa: E402
from satchel.plans.context import contexts  # noqa: E402
from satchel.plans.migrate import migrate  # noqa: E402
from satchel.plans.search import search  # noqa: E402
from satchel.plans.sync import sync  # noqa: E402
from satchel.session import build_session, scratch_path, staged  # noqa: E402
from satchel.sources.imports import import_documents  # noqa: E402
from satchel.sources.indexes import CellIndex, WordIndex  # noqa: E402
from satchel.sources.store import PointStore  # noqa: E402
from workload.base import MODEL, Tables  # noqa: E402
from workload.sources import scroll  # noqa: E402


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    # Python workers and generated code are warm before anything is timed.
    consume(Tables(spark, sf_dir).questions)
    times: dict[str, float] = {}

    def timed(name: str, run):
        start = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    store = PointStore(spark, scratch_path(spark, "store"), buckets=2)
    words = WordIndex.create(store, 8)
    timed("first_sync", lambda: consume(sync(store, t.files, model=MODEL)))
    timed("repeated_sync", lambda: consume(sync(store, t.files, model=MODEL)))
    edited = t.files_of(t.edited_documents)
    timed("changed_sync", lambda: consume(sync(store, edited, model=MODEL)))
    points = store.points()
    questions = timed("embed_questions", lambda: staged(t.questions, "questions"))
    scorer = term_overlap(F.col("query"), F.col("content"))
    plain = questions.withColumn("compress", F.lit(False))

    probe = [float(x) for x in t.embeddings.agg(F.min_by("embedding", "vec_id")).first()[0]]
    timed("dense_one_query", lambda: nearest(t.vectors, probe, 5).collect())
    timed("dense_query_batch", lambda: consume(dense_topk(t.vectors, t.vector_queries)))
    timed("dense_search", lambda: consume(search(plain.withColumn("hybrid", F.lit(False)), points, buckets=2).results))
    for n in (1, 100):
        few = staged(plain.orderBy("query_id").limit(n), "few-questions")
        timed(f"hybrid_{n}_question{'s' * (n > 1)}", lambda few=few: consume(search(few, points, buckets=2, words=words).results))
    timed("hybrid_search", lambda: consume(search(plain, points, buckets=2).results))
    timed("hybrid_search_postings", lambda: consume(search(plain, points, buckets=2, words=words).results))
    cells = timed("build_cells", lambda: CellIndex.create(store, 32))
    one = staged(plain.orderBy("query_id").limit(1), "few-questions")
    timed("hybrid_1_question_in_cells", lambda: consume(search(one, points, buckets=2, words=words, cells=cells, probes=8).results))
    timed("hybrid_rerank_compress", lambda: consume(search(questions, points, scorer=scorer, buckets=2).results))
    timed("retrieve_context", lambda: consume(contexts(questions, search(questions, points, scorer=scorer, buckets=2).results)))

    target = PointStore(spark, scratch_path(spark, "store"), buckets=2)
    timed("migrate_pages", lambda: migrate(target, "moved", documents=import_documents(scroll(t), "pages"), model=MODEL))
    timed("project_counts", lambda: consume(reports.chunk_counts(points)))
    timed("top_files", lambda: consume(reports.top_files(points)))
    timed("latency_percentiles", lambda: consume(percentiles(t.query_log, "latency_ms", reports.P50_P95)))
    timed("latency_by_project", lambda: consume(percentiles(t.query_log, "latency_ms", reports.P50_P95, ["project_id"])))
    timed("recent_latency", lambda: consume(reports.recent_latency_summary(t.query_log)))

    name = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": float(name) if name.replace(".", "", 1).isdigit() else name,
                "questions": questions.count(), "chunks": points.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
