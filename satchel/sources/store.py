"""The point table: keyed rows in Parquet, replaced partition by partition.

Rows are spread over (project, bucket) partitions, the bucket being a hash of
the file a chunk came from. A commit rewrites only partitions that gain,
change or lose rows, under a new version, then writes the list of live
partitions. A commit exists once that list does; readers keep the version
they opened. One writer at a time.

The list also holds the settings of the store (bucket count, postings or
not). They are fixed by the first commit; opening a store reads them, and
asking for others is refused. A commit leaves one row per key.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satchel.operators.keyed import KEY, last_wins
from satchel.operators.lexical import build_postings
from satchel.schema import POINT, POSTING
from satchel.session import small_splits, staged
from satchel.sources.indexes import kept_up

_LIVE = "project_id string, project_key string, bucket int, version int, buckets int, with_postings boolean"
DEFAULT_BUCKETS = 8
SLICE_ROWS = 50_000  # rows of a partition that may go to one task
_PLACE = (("project_key", T.StringType()), ("bucket", T.IntegerType()))


def _with_place(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t) for n, t in _PLACE])


def project_key(project_id: str) -> str:
    """Folder-safe name of a project."""
    return hashlib.sha256(project_id.encode()).hexdigest()[:16]


def place(df: DataFrame, buckets: int) -> DataFrame:
    """Add the partition columns. The bucket depends on the id alone, with the
    chunk number cut off, so that chunks of one file stay together."""
    owner: Column = F.regexp_replace("id", r"#chunk[0-9]+$", "")
    return df.withColumn("project_key", F.substring(F.sha2("project_id", 256), 1, 16)).withColumn(
        "bucket", F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")
    )


class PointStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, with_postings: bool | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        held = self.live().select("buckets", "with_postings").first()
        for name, asked in (("buckets", buckets), ("with_postings", with_postings)):
            if held is not None and asked is not None and asked != held[name]:
                raise ValueError(f"the store at {self.root} was made with {name}={held[name]}, not {asked}")
        self.buckets: int = held["buckets"] if held is not None else buckets or DEFAULT_BUCKETS
        self.with_postings: bool = held["with_postings"] if held is not None else bool(with_postings)

    # -- versions ---------------------------------------------------------

    def _folder(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int:
        """Number of the latest commit, 0 before the first."""
        path, fs = self._folder(f"{self.root}/live")
        if not fs.exists(path):
            return 0
        done = []
        for entry in fs.listStatus(path):
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if fs.exists(marker):
                done.append(int(entry.getPath().getName().split("=")[1]))
        return max(done, default=0)

    def live(self, version: int | None = None) -> DataFrame:
        """Live partitions: project_id, project_key, bucket, version."""
        at = self.version() if version is None else version
        if at == 0:
            return self.spark.createDataFrame([], _LIVE)
        return self.spark.read.schema(_LIVE).parquet(f"{self.root}/live/v={at}")

    # -- reads ------------------------------------------------------------

    def _read(self, table: str, schema: T.StructType, live: list) -> DataFrame:
        """One scan over the folders of the given live partitions."""
        placed = _with_place(schema)
        base = f"{self.root}/{table}"
        paths = {
            f"{base}/v={r['version']}/project_key={r['project_key']}/bucket={r['bucket']}" for r in live if r["bucket"] >= 0
        }
        if not paths:
            # A limit of 0 tells the planner that there is nothing to join with.
            return self.spark.createDataFrame([], placed).limit(0)
        versioned = T.StructType(list(placed.fields) + [T.StructField("v", T.IntegerType())])
        return self.spark.read.schema(versioned).option("basePath", base).parquet(*sorted(paths)).drop("v")

    def _of_projects(self, table: str, schema: T.StructType, project_ids: list[str] | None) -> DataFrame:
        live = self.live().collect()
        if project_ids is None:
            return self._read(table, schema, live)
        found = self._read(table, schema, [r for r in live if r["project_id"] in project_ids])
        return found.where(F.col("project_id").isin(project_ids))

    def points(self, project_ids: list[str] | None = None) -> DataFrame:
        return self._of_projects("points", POINT, project_ids)

    def postings(self, project_ids: list[str] | None = None) -> DataFrame:
        if not self.with_postings:
            raise ValueError("this store was made without postings")
        return self._of_projects("postings", POSTING, project_ids)

    def projects(self) -> DataFrame:
        """Known projects, including created ones without points."""
        return self.live().select("project_id").distinct()

    # -- writes -----------------------------------------------------------

    def create_project(self, project_id: str) -> int:
        """Register a project; a known one is left alone."""
        rows = [tuple(r)[:4] for r in self.live().collect()]
        if any(r[0] == project_id for r in rows):
            return self.version()
        return self._publish([*rows, (project_id, project_key(project_id), -1, 0)], self.version() + 1)

    def delete_project(self, project_id: str) -> int:
        rows = [tuple(r)[:4] for r in self.live().collect() if r["project_id"] != project_id]
        return self._publish(rows, self.version() + 1)

    def upsert(self, points: DataFrame, ordinal: str | None = None, keys: DataFrame | None = None) -> int:
        """Insert points; a known (project, id) is replaced as a whole. Of
        several rows with one key the one with the highest ordinal stays."""
        if ordinal:
            points = last_wins(points, ordinal=ordinal)
        return self.commit(upserts=points, keys=keys)

    def insert(self, points: DataFrame) -> int:
        """Add points whose (project, id) is not stored yet; others are left as they are."""
        known = self.points().select(*KEY)
        return self.commit(upserts=points.join(known, list(KEY), "left_anti"))

    def delete_points(self, keys: DataFrame) -> int:
        return self.commit(deletes=staged(keys.select(*KEY), "deletes"))

    def commit(
        self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, keys: DataFrame | None = None
    ) -> int:
        """Apply upserts and deletes together as one new version. Of several
        upserts with one key one stays (the largest by content hash, then
        content); a key in both is kept. ``deletes`` must not depend on later
        states of this store.

        ``keys`` are the keys of ``upserts`` from a cheaper source. With them
        the upserts are computed once, straight into the table; without, they
        are staged first, as they feed several steps.
        """
        current = self.version()
        before = self.live(current)
        changes = []
        fresh = None
        if upserts is not None:
            rows = upserts.select(*POINT.fieldNames())
            if keys is None:
                rows = staged(rows, "upserts")
                keys = rows
            # Keys are unique as a rule; only where they are not are rows put in order.
            twice = keys.groupBy(*KEY).count().where("count > 1").select(*KEY)
            if not twice.isEmpty():
                twice = staged(twice, "twice")
                rows = staged(rows, "upserts")  # used twice from here on
                order = F.struct(*[F.coalesce(c, F.lit("")) for c in ("content_hash", "content")])
                meta = F.map_entries("meta").alias("meta")  # maps can't be compared or picked by an aggregate
                several = rows.join(twice, list(KEY), "left_semi").select(*[meta if c == "meta" else c for c in POINT.fieldNames()], order.alias("ordinal"))
                one = last_wins(several).withColumn("meta", F.map_from_entries("meta")).select(*POINT.fieldNames())
                rows = rows.join(twice, list(KEY), "left_anti").select(*POINT.fieldNames()).unionByName(one)
            fresh = place(rows, self.buckets)
            changes.append(place(keys.select(*KEY), self.buckets))
        if deletes is not None:
            changes.append(place(deletes.select(*KEY), self.buckets))
        changed = reduce(DataFrame.unionByName, changes)
        # Cells and live rows number as many as the table has partitions.
        cells = {(r[0], r[1]) for r in changed.select("project_key", "bucket").distinct().collect()}
        if not cells:
            return current
        old = before.collect()
        touched = [r for r in old if (r["project_key"], r["bucket"]) in cells and r["bucket"] >= 0]
        version = current + 1
        if touched:
            gone = None if deletes is None else place(deletes.select(*KEY), self.buckets)
            rows = self._replaced(self._read("points", POINT, touched), fresh, gone)
            self._write("points", rows, version, dealt=True)
        else:
            self._write("points", fresh if fresh is not None else self._read("points", POINT, []), version)
        written = self.spark.read.schema(_with_place(POINT)).parquet(f"{self.root}/points/v={version}")
        if self.with_postings:
            # A posting lies where its point lies, which the point's row tells.
            with small_splits(self.spark):
                self._write("postings", build_postings(written, carried=["project_key", "bucket"]), version)
        for index in kept_up(self):
            index.write(written, version)
        filled = written.select("project_id", "project_key", "bucket").distinct().collect()
        rows = {tuple(r)[:4] for r in old if (r["project_key"], r["bucket"]) not in cells}
        rows |= {(r[0], r[1], r[2], version) for r in filled}
        # Registration rows (bucket -1) keep a project known when it is empty.
        rows |= {(r[0], r[1], -1, 0) for r in filled}
        return self._publish(sorted(rows), version)

    def _replaced(self, old: DataFrame, fresh: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        """The rows of rewritten partitions: ``old`` ones whose key is neither
        in ``fresh`` nor in ``gone``, and ``fresh``. Whole rows are shuffled
        once, to where they are written; there the rows of a key meet. Large
        partitions are dealt in slices, so that no task gets a whole one."""
        largest = old.groupBy("project_key", "bucket").count().agg(F.max("count")).first()[0] or 0
        slices = 1 + int(largest) // SLICE_ROWS
        parts = [df.withColumn("_new", F.lit(new)) for df, new in ((old, 0), (gone, 1), (fresh, 2)) if df is not None]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices))).repartition("project_key", "bucket", "_slice")
        # In the order in which rows are written, so they are sorted once.
        same = Window.partitionBy("project_key", "bucket", "id", "project_id", "_slice")
        stays = (F.max("_new").over(same) == 0) | F.col("project_id").isNull() | F.col("id").isNull()
        left = rows.withColumn("_stays", stays).where((F.col("_new") == 2) | ((F.col("_new") == 0) & F.col("_stays")))
        return left.select(*old.columns)

    def _write(self, table: str, df: DataFrame, version: int, dealt: bool = False) -> None:
        if table == "points" and not dealt:
            # Rebalancing gathers the rows of a partition into few files and
            # still splits one that is too large for a task. Postings need no
            # shuffle: they are made from files that are already gathered.
            df = df.hint("rebalance", "project_key", "bucket")
        order = "term" if table == "postings" else "id"
        # A half-written version left by a failed commit is replaced.
        (
            df.sortWithinPartitions("project_key", "bucket", order)
            .write.mode("overwrite")
            .partitionBy("project_key", "bucket")
            .parquet(f"{self.root}/{table}/v={version}")
        )

    def _publish(self, rows: list[tuple], version: int) -> int:
        live = self.spark.createDataFrame([(*r, self.buckets, self.with_postings) for r in rows], _LIVE)
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/live/v={version}")
        return version

    def vacuum(self, keep: int = 1) -> list[int]:
        """Delete data and lists of versions no live partition of the last
        ``keep`` commits refers to."""
        latest = self.version()
        first_kept = max(1, latest - keep + 1)
        used = set()
        for v in range(first_kept, latest + 1):
            used |= {r["version"] for r in self.live(v).select("version").distinct().collect()}
        removed = []
        for v in range(1, first_kept):
            for table in ("live",) if v in used else ("live", "points", "postings", "words", "terms", "cells"):
                path, fs = self._folder(f"{self.root}/{table}/v={v}")
                if fs.exists(path):
                    fs.delete(path, True)
                    removed.append(v)
        return sorted(set(removed))
