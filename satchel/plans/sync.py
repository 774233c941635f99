"""Bringing a store in step with a set of files, and direct indexing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satchel.functions.meta import chunk_meta, own_identity
from satchel.operators.chunking import DEFAULT_CHUNK_CHARS, chunk_files
from satchel.operators.embedding import hash_embed
from satchel.operators.keyed import KEY
from satchel.operators.points import to_points
from satchel.operators.usage import Metered
from satchel.schema import FILE
from satchel.session import staged
from satchel.sources.files import current_files
from satchel.sources.store import PointStore
from satchel.streaming.events import events_from, publish

NAMED_PROJECTS = 1_000  # projects that are named to the store one by one
# Adds ``embedding`` to rows that have ``content``.
EmbedStage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SyncChange:
    """What a sync would do. ``chunks`` flags unchanged ones; ``stale`` lists
    keys to delete; ``files`` are those present."""

    chunks: DataFrame
    stale: DataFrame
    files: DataFrame

    def to_index(self) -> DataFrame:
        return self.chunks.where(~F.col("unchanged")).drop("unchanged")

    def result(self) -> DataFrame:
        """indexed, skipped, deleted, files_scanned per project."""
        zero = F.lit(0).cast("long")
        none = {c: zero.alias(c) for c in ("indexed", "skipped", "deleted", "files_scanned")}

        def part(counts: DataFrame, *names: str) -> DataFrame:
            return counts.select("project_id", *[F.col(c) if c in names else none[c] for c in none])

        chunks = self.chunks.groupBy("project_id").agg(
            F.count_if(~F.col("unchanged")).alias("indexed"), F.count_if(F.col("unchanged")).alias("skipped")
        )
        stale = self.stale.groupBy("project_id").agg(F.count("*").alias("deleted"))
        files = self.files.groupBy("project_id").agg(F.count("*").alias("files_scanned"))
        return (
            part(chunks, "indexed", "skipped")
            .unionByName(part(stale, "deleted"))
            .unionByName(part(files, "files_scanned"))
            .groupBy("project_id")
            .agg(*[F.sum(c).alias(c) for c in none])
        )


def known_hashes(existing: DataFrame) -> DataFrame:
    """project_id, id, content_hash of rows usable for skipping."""
    return existing.where(F.coalesce("content_hash", F.lit("")) != "").select(
        "project_id", own_identity(F.col("doc_id"), F.col("id")).alias("id"), "source_dir", "content_hash"
    )


_SAME = ["project_id", "id", "source_dir", "content_hash"]


def unchanged_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """What tells apart the chunks that are stored with the same hash; no text moves."""
    return chunks.select(*_SAME).join(known_hashes(existing).select(*_SAME), _SAME, "left_semi")


def mark_unchanged(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Flag chunks whose id is stored with the same hash. The join key is a
    chunk's own identity, so no key is hot."""
    known = known_hashes(existing).select(*_SAME).distinct().withColumn("_known", F.lit(True))
    return chunks.join(known, _SAME, "left").withColumn("unchanged", F.col("_known").isNotNull()).drop("_known")


def stale_points(existing: DataFrame, files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Stored keys whose file is no longer present in its source directory.

    Only directories that were scanned now are considered. With ``chunks``
    also the tail of shrunk files: keys of readable files not made this time.
    """
    place = ["project_id", "source_dir", "source_file"]
    present = current_files(files).select("project_id", "source_dir", F.col("rel_path").alias("source_file"))
    scanned = present.select("project_id", "source_dir").distinct()
    ours = (
        existing.select(*KEY, "source_dir", "source_file")
        .where(F.coalesce("source_file", F.lit("")) != "")
        .join(scanned, ["project_id", "source_dir"], "left_semi")
    )
    gone = ours.join(present, place, "left_anti")
    if chunks is not None:
        made_files = chunks.select(*place).distinct()
        tail = ours.join(made_files, place, "left_semi").join(chunks.select(*KEY), list(KEY), "left_anti")
        gone = gone.unionByName(tail)
    return gone.select(*KEY)


def mostly_repeated(counted: DataFrame) -> bool:
    """Whether more than a tenth of the counted paths (``n``) come several times."""
    seen = counted.agg(F.count("*").alias("paths"), F.count_if(F.col("n") > 1).alias("twice")).first()
    return seen["twice"] * 10 > seen["paths"]


def one_version(files: DataFrame) -> DataFrame:
    """Files read once and written down, one row per path: of several texts of
    one path the larger one stays whole (a row without a text gives way). Texts
    move only for paths that come more than once."""
    place = ["project_id", "source_dir", "rel_path"]
    files = staged(files.select(*FILE.fieldNames()), "sync-files")
    counted = files.groupBy(*place).agg(F.count("*").alias("n"))
    if mostly_repeated(counted):
        # Looking the repeated ones up would move every text twice.
        one = files.groupBy(*place).agg(F.max(F.struct("text", "length")).alias("f"))
        return staged(one.select(*place, "f.length", "f.text"), "sync-files")
    twice = staged(counted.where("n > 1").select(*place), "repeated-paths")
    if twice.isEmpty():
        return files
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in place]
    several = files.join(twice, same(files, twice), "left_semi").groupBy(*place).agg(F.max(F.struct("text", "length")).alias("f"))
    one = several.select(*place, "f.length", "f.text")
    return staged(files.join(twice, same(files, twice), "left_anti").unionByName(one), "sync-files")


def plan_sync(
    files: DataFrame, existing: DataFrame, max_chars: int = DEFAULT_CHUNK_CHARS, prune_tail: bool = False
) -> SyncChange:
    """Compare FILE rows of any number of projects with the stored points."""
    chunks = mark_unchanged(chunk_files(files, max_chars), existing)
    stale = stale_points(existing, files, chunks if prune_tail else None)
    return SyncChange(chunks, stale, current_files(files))


def chunk_points(chunks: DataFrame, embed: EmbedStage = hash_embed, model: str | None = None) -> DataFrame:
    """Stored form of chunk rows."""
    documents = chunks.select(
        "project_id",
        "id",
        "content",
        chunk_meta(F.col("source_file"), F.col("source_dir"), F.col("position"), F.col("content_hash")).alias("meta"),
    )
    return to_points(embed(documents), model)


def sync(
    store: PointStore,
    files: DataFrame,
    embed: EmbedStage = hash_embed,
    model: str | None = None,
    max_chars: int = DEFAULT_CHUNK_CHARS,
    prune_tail: bool = False,
    project_ids: list[str] | None = None,
    usage: str | None = None,
    events: str | None = None,
) -> DataFrame:
    """Index new and changed chunks, drop stale points, report the counts.

    Running it again on the same files changes nothing. Only chunks that are
    new or changed are embedded. Each file is read once; of several versions of
    a path one is taken as a whole. The comparison reads the partitions of the
    projects at hand; ``project_ids`` saves finding them out. ``usage`` names a
    log to which the tokens spent are added, ``events`` one that is told of the
    start and the end of the run in each project.
    """
    files = one_version(files)
    if events is not None:
        publish(events_from(files.groupBy("project_id").agg(F.min("source_dir").alias("directory")), "index_started", "directory"), events)
    try:
        report = _synced(store, files, embed, model, max_chars, prune_tail, project_ids, usage)
    except Exception as failure:
        if events is not None:
            error = F.lit(f"{type(failure).__name__}: {str(failure)[:500]}").alias("error")
            publish(events_from(files.select("project_id", error).distinct(), "index_failed", "error"), events)
        raise
    if events is not None:
        publish(events_from(report, "index_completed", "indexed", "skipped", "deleted", "files_scanned"), events)
    return report


def _synced(store: PointStore, files: DataFrame, embed: EmbedStage, model: str | None, max_chars: int, prune_tail: bool, project_ids: list[str] | None, usage: str | None) -> DataFrame:
    if project_ids is None:
        found = [r[0] for r in files.select("project_id").distinct().limit(NAMED_PROJECTS + 1).collect()]
        project_ids = found if len(found) <= NAMED_PROJECTS else None
    existing = store.points(project_ids)
    change = plan_sync(files, existing, max_chars, prune_tail)
    # Feeds the counters and the embedding, after which the store has moved.
    # Of unchanged chunks only ids and hashes are written.
    narrow = change.chunks.withColumn("content", F.when(~F.col("unchanged"), F.col("content"))).drop("chunk")
    marked = staged(narrow, "sync-chunks")
    change = SyncChange(marked, staged(change.stale, "sync-stale"), change.files)
    fresh = change.to_index()
    metered = Metered(embed, "embed", model, usage)
    store.commit(upserts=chunk_points(fresh, metered, model), deletes=change.stale, keys=fresh.select(*KEY))
    metered.record(marked.sparkSession)
    return change.result()


def index_documents(
    store: PointStore,
    documents: DataFrame,
    project_id: str,
    embed: EmbedStage = hash_embed,
    model: str | None = None,
    usage: str | None = None,
) -> int:
    """Store caller-supplied documents of one project; of repeated ids in a
    call the last one stays. Returns the count of documents handed in."""
    numbered = documents.withColumn("project_id", F.lit(project_id)).withColumn(
        "ordinal", F.monotonically_increasing_id()
    )
    taken = staged(numbered, "documents")
    metered = Metered(embed, "embed", model, usage)
    points = to_points(metered(last_of_call(taken)), model)
    store.upsert(points, keys=taken.select(*KEY).distinct())
    metered.record(taken.sparkSession)
    return taken.count()


def last_of_call(numbered: DataFrame) -> DataFrame:
    picked = numbered.groupBy(*KEY).agg(F.max_by(F.struct("content", F.map_entries("meta").alias("meta")), "ordinal").alias("d"))
    return picked.select(*KEY, F.col("d.content").alias("content"), F.map_from_entries("d.meta").alias("meta"))
