"""Continuous sync: batches of changed files applied to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from satchel.operators.chunking import DEFAULT_CHUNK_CHARS, chunk_files
from satchel.operators.embedding import hash_embed
from satchel.operators.keyed import KEY
from satchel.plans.sync import EmbedStage, chunk_points, mostly_repeated, unchanged_chunks
from satchel.session import broadcast_if_small, drop_scratch, scratch_path, staged
from satchel.sources.store import PointStore


def last_changes(changes: DataFrame) -> DataFrame:
    """One row per path of a batch. Texts move only for paths that come more
    than once, unless those are many."""
    place = ["project_id", "source_dir", "rel_path"]
    counted = changes.groupBy(*place).agg(F.count("*").alias("n"))
    if mostly_repeated(counted):
        return _last_of_path(changes, place)
    plain = changes.select(*[c for c in changes.columns if c != "ordinal"])
    twice = staged(counted.where("n > 1").select(*place), "repeated-paths")
    if twice.isEmpty():
        return plain
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in place]
    several = _last_of_path(changes.join(twice, same(changes, twice), "left_semi"), place)
    return plain.join(twice, same(plain, twice), "left_anti").unionByName(several)


def _last_of_path(changes: DataFrame, place: list[str]) -> DataFrame:
    ordinal = F.col("ordinal") if "ordinal" in changes.columns else F.lit(0)
    rest = [c for c in changes.columns if c not in (*place, "ordinal")]
    order = F.struct(ordinal.alias("o"), (~F.col("deleted")).alias("d"), F.col("text").alias("t"))
    others = [c for c in rest if c not in ("deleted", "text")]
    if all(changes.schema[c].dataType.typeName() not in ("map", "variant") for c in others):
        # The text moves once, as a part of the order.
        best = F.max(F.struct(ordinal.alias("_o"), (~F.col("deleted")).alias("_d"), "text", *others)).alias("_row")
        picked = changes.groupBy(*place).agg(best).select(*place, "_row.*").withColumn("deleted", ~F.col("_d"))
        return picked.select(*[c for c in changes.columns if c != "ordinal"])
    picked = changes.groupBy(*place).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*place, "_row.*").select(*[c for c in changes.columns if c != "ordinal"])


def apply_changes(
    store: PointStore,
    changes: DataFrame,
    embed: EmbedStage = hash_embed,
    model: str | None = None,
    max_chars: int = DEFAULT_CHUNK_CHARS,
) -> None:
    """Index changed files and drop the points of files marked ``deleted``.

    Absence from a change batch means nothing, so only marked files go. Chunks
    already stored with the same hash are skipped, which makes a repeated
    batch harmless. Of several changes of one path the last one counts: the
    highest ``ordinal`` if there is such a column; among equals a text counts
    before a deletion, then the larger text.

    Texts are written down once, as chunks; what is stored already is found
    out by ids and hashes alone. Nothing of that is left after the commit.
    """
    own = scratch_path(store.spark, "stream")
    changes = last_changes(changes)
    existing = store.points(sorted(r[0] for r in changes.select("project_id").distinct().collect()))
    place = ["project_id", "source_dir", "source_file"]
    removed = changes.where("deleted").select("project_id", "source_dir", F.col("rel_path").alias("source_file")).distinct()
    gone = existing.select(*KEY, "source_dir", "source_file").join(removed, place, "left_semi").select(*KEY)
    alive = changes.where(~F.col("deleted")).drop("deleted")
    chunks = staged(chunk_files(alive, max_chars).drop("chunk"), "chunks", own)
    unchanged = staged(unchanged_chunks(chunks, existing), "unchanged", own)
    to_index = chunks
    if not unchanged.isEmpty():
        to_index = chunks.join(broadcast_if_small(unchanged), unchanged.columns, "left_anti")
    store.commit(upserts=chunk_points(to_index, embed, model), deletes=staged(gone, "gone", own), keys=to_index.select(*KEY))
    drop_scratch(store.spark, own)


def continuous_sync(
    stream: DataFrame,
    store: PointStore,
    checkpoint: str,
    embed: EmbedStage = hash_embed,
    model: str | None = None,
    once: bool = False,
    keep: int | None = None,
) -> StreamingQuery:
    """``stream`` has FILE columns and a boolean ``deleted``. Each batch leaves
    a version of the store; with ``keep`` only the last ones stay, so a reader
    must not be more commits behind than that."""

    def step(batch: DataFrame, batch_id: int) -> None:
        own = scratch_path(store.spark, "changes")
        apply_changes(store, staged(batch, "batch", own), embed, model)
        drop_scratch(store.spark, own)
        if keep is not None:
            store.vacuum(keep)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
