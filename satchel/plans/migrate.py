"""Moving documents between projects or from exported pages, with new vectors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.operators.embedding import hash_embed
from satchel.operators.points import export_documents, to_points
from satchel.operators.reports import batch_progress, percent_changes
from satchel.operators.usage import Metered
from satchel.plans.sync import EmbedStage, last_of_call
from satchel.session import is_small, scratch_root, staged
from satchel.sources.store import PointStore
from satchel.streaming.events import finished_rounds, told

BATCH = 64


@dataclass(frozen=True)
class Migration:
    written: int
    progress: DataFrame
    run_id: str = ""


def reembedded(
    documents: DataFrame, project_id: str, embed: EmbedStage = hash_embed, model: str | None = None, repeated: DataFrame | None = None
) -> DataFrame:
    """POINT rows of the destination; vectors are always made anew. Of repeated
    ids the one with the highest ``ordinal`` stays, or the last row. Where the
    ``repeated`` ids are known, only their rows are moved to be told apart."""
    numbered = documents.withColumn("project_id", F.lit(project_id))
    if "ordinal" not in documents.columns:
        numbered = numbered.withColumn("ordinal", F.monotonically_increasing_id())
    if repeated is None:
        return to_points(embed(last_of_call(numbered)), model)
    again = F.broadcast(repeated.select(F.col("id").alias("_again")))
    several = F.col("id").eqNullSafe(F.col("_again"))
    last = last_of_call(numbered.join(again, several, "left_semi"))
    return to_points(embed(numbered.join(again, several, "left_anti").select(*last.columns).unionByName(last)), model)


def _repeated(taken: DataFrame) -> DataFrame | None:
    """The ids of several documents, if they are few enough to be sent along."""
    ids = staged(taken.groupBy("id").count().where("count > 1").select("id"), "repeated")
    return ids if is_small(ids) else None


def _taken(documents: DataFrame, run_id: str) -> DataFrame:
    """The run's documents as they were handed in, numbered in that order and
    written once; a resumed run finds them where it left them. Metadata that
    repeats the text (exported payloads hold it) is written as its key."""
    spark = documents.sparkSession
    path = f"{scratch_root(spark)}/migration-{run_id}"
    rows = documents.select("id", "content", "meta").withColumn("ordinal", F.monotonically_increasing_id())
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    is_text = lambda v: v.eqNullSafe(F.col("content"))
    slim = rows.withColumn("texts", F.map_keys(F.map_filter("meta", lambda k, v: is_text(v)))).withColumn("meta", F.map_filter("meta", lambda k, v: ~is_text(v)))
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        slim.write.mode("overwrite").parquet(path)
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    whole = F.map_concat("meta", F.map_from_entries(F.transform(texts, lambda k: F.struct(k.alias("key"), F.col("content").alias("value")))))
    return spark.read.schema(slim.schema).parquet(path).withColumn("meta", whole).drop("texts")


def migrate(
    destination: PointStore,
    dest_project: str,
    documents: DataFrame | None = None,
    source: PointStore | None = None,
    source_project: str | None = None,
    embed: EmbedStage = hash_embed,
    model: str | None = None,
    batch: int = BATCH,
    rounds: int = 1,
    run_id: str | None = None,
    events: str | None = None,
    usage: str | None = None,
) -> Migration:
    """Copy imported ``documents``, or a project of ``source``, re-embedded.

    The documents are dealt into ``rounds`` by a hash of their ids; each round
    is one commit. With an ``events`` log the run tells when it starts, after
    each round the rows at which the whole percent changed, and how it ended.
    A run that failed is taken up again by its ``run_id``: rounds it has told
    of are not done twice. Tokens go to the ``usage`` log.

    The progress rows returned are those at which the whole percent changed.
    """
    if documents is None:
        if source is None or not source_project:
            raise ValueError("a migration needs documents or a source project")
        if source.root == destination.root and source_project == dest_project:
            raise ValueError("source and destination are the same project")
        documents = export_documents(source.points([source_project])).drop("project_id")
    run_id = run_id or uuid.uuid4().hex
    spark = documents.sparkSession
    tell = lambda kind, **data: told(spark, events, kind, dest_project, run_id=run_id, **data)
    ends = {"source": source_project or "", "dest": dest_project}
    before = finished_rounds(spark, events, run_id)
    if not before:
        tell("migration_started", **ends)
    try:
        taken = _taken(documents, run_id)
        repeated = _repeated(taken)
        taken = taken.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int"))
        sizes = {r["round"]: r["n"] for r in taken.groupBy("round").agg(F.count("*").alias("n")).collect()}
        total = sum(sizes.values())
        totals = spark.range(1).select(F.lit(dest_project).alias("project_id"), F.lit(total).cast("long").alias("total"))
        progress = percent_changes(batch_progress(totals, batch))
        destination.create_project(dest_project)
        done = 0
        for number in range(rounds):
            since, done = done, done + sizes.get(number, 0)
            if number in before:
                continue
            rows = taken.where(F.col("round") == number).drop("round")
            if sizes.get(number):
                metered = Metered(embed, "embed", model, usage)
                keys = rows.select(F.lit(dest_project).alias("project_id"), "id").distinct()
                destination.upsert(reembedded(rows, dest_project, metered, model, repeated), keys=keys)
                metered.record(spark)
            if events is not None:
                # One row for each whole percent at most.
                first = number == 0
                for r in progress.where((F.col("done") > (-1 if first else since)) & (F.col("done") <= done)).orderBy("seq").collect():
                    tell("migration_progress", done=r["done"], total=r["total"], percent=r["percent"], **ends)
                tell("migration_progress", round=number, done=done, total=total, **ends)
    except Exception as failure:
        tell("migration_failed", error=f"{type(failure).__name__}: {str(failure)[:500]}", **ends)
        raise
    tell("migration_completed", **ends)
    return Migration(total, progress, run_id)
