"""Keyed streaming state: recent rows, progress by percent, changed groups.

State lives in the stream's own store, which is rewritten only for the keys
that a batch touches, and is read back from the checkpoint as a table. Keyed
operators need the RocksDB state store; it is set for the queries started here
and left as it was for others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from satchel.operators.ranking import latest

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICES = 16  # slices of a group, so that a hot one is spread over tasks
PARTS = 1_024  # keys of the state that slices of all groups are dealt to
PACK = 10_000  # rows under one key that make one row of state
COMPACT = 32  # batches after which the changes are gathered


@contextmanager
def _rocksdb(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _lists(frame: pd.DataFrame) -> tuple[list, ...]:
    """A frame as one list for each column. State takes a row at a time, so rows
    that are kept together are packed into one."""
    return tuple(_values(frame[c]) for c in frame.columns)


def _values(column: pd.Series) -> list:
    """The values of a pandas column as state takes them."""
    if column.dtype.kind == "M":
        return column.to_numpy(dtype="datetime64[us]").tolist()
    return column.astype(object).where(column.notna(), None).tolist()


def _packed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])


def _endless(ttl_ms: int | None, once: bool) -> None:
    if ttl_ms and once:
        raise ValueError("state with a time to live needs a stream that runs on")


class _Recent(StatefulProcessor):
    """Rows of many groups under one key. A batch appends its own rows; once
    those that were appended are as many as those before them, all are cut to
    the first ``n`` of each group and written anew."""

    def __init__(self, schema: T.StructType, n: int, group: list[str], order: list[str], ttl_ms: int | None):
        self.schema, self.n, self.group, self.order, self.ttl_ms = schema, n, group, order, ttl_ms
        self.whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegralType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        sizes = T.StructType([T.StructField("cut", T.LongType()), T.StructField("appended", T.LongType())])
        self.kept = handle.getListState("recent", _packed(self.schema), ttlDurationMs=self.ttl_ms)
        self.sizes = handle.getValueState("sizes", sizes, ttlDurationMs=self.ttl_ms)

    def best(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        # Equal rows are one row, so a batch that is run again changes nothing.
        every = pd.concat(parts, ignore_index=True).drop_duplicates()
        placed = every.sort_values(self.order, ascending=False, na_position="last", kind="stable")
        return placed.groupby(self.group, dropna=False, sort=False).head(self.n) if self.group else placed.head(self.n)

    def frame(self, packed: tuple) -> pd.DataFrame:
        columns = dict(zip(self.schema.fieldNames(), packed))
        return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in self.whole else v for c, v in columns.items()})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = self.schema.fieldNames()
        best = self.best([r[names].astype({c: "Int64" for c in self.whole}) for r in rows])
        cut, appended = self.sizes.get() if self.sizes.exists() else (0, 0)
        # With a time to live what is kept of a group is renewed with its new rows.
        anew = self.ttl_ms is not None or appended + len(best) >= cut
        if anew and cut:
            best = self.best([best, *[self.frame(k) for k in self.kept.get()]])
        packs = [_lists(best.iloc[at : at + PACK]) for at in range(0, len(best), PACK)]
        if anew:
            self.kept.put(packs)
            self.sizes.update((len(best), 0))
        else:
            self.kept.appendList(packs)
            self.sizes.update((cut, appended + len(best)))
        yield pd.DataFrame({"rows": [len(best)]})

    def close(self) -> None:
        pass


def keep_recent_keyed(
    stream: DataFrame, checkpoint: str, n: int, group: Sequence[str], tie: str = "event_id", ttl_ms: int | None = None, once: bool = False
) -> StreamingQuery:
    """Keep the ``n`` most recent rows (``ts``, then ``tie``) of each group as
    list state. A group is kept in slices by a hash of ``tie``, each with its
    own ``n`` rows, so no task holds a hot group; ``recent_rows`` takes the
    first ``n`` of them all. Slices of many groups share a key of the state,
    as each key costs calls of its own; the keys number ``PARTS``, for good.
    With ``ttl_ms`` each slice has its own key, so that groups that get no
    rows expire; such a stream looks at the clock for ever, so it can not run
    just once."""
    _endless(ttl_ms, once)
    work = _Recent(stream.schema, n, list(group), ["ts", tie], ttl_ms)
    piece = F.pmod(F.xxhash64(tie), F.lit(SLICES)).cast("int")
    if ttl_ms:
        keyed = stream.withColumn("_slice", piece).groupBy(*group, "_slice")
    else:
        keyed = stream.withColumn("_part", F.pmod(F.xxhash64(*group, piece), F.lit(PARTS)).cast("int")).groupBy("_part")
    kept = keyed.transformWithStateInPandas(work, "rows long", "Update", "ProcessingTime" if ttl_ms else "None")
    writer = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    with _rocksdb(stream.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def recent_rows(spark: SparkSession, checkpoint: str, n: int, group: Sequence[str], tie: str = "event_id") -> DataFrame:
    """The state of ``keep_recent_keyed`` after its last finished batch."""
    state = spark.read.format("statestore").option("stateVarName", "recent").load(checkpoint)
    # With a time to live the rows stand one level down.
    held = state.schema["list_element"].dataType
    element = "list_element"
    if "ttlExpirationMs" in held.fieldNames():
        held, element = held["value"].dataType, "list_element.value"
    zipped = F.arrays_zip(*[F.col(f"{element}.`{c}`").alias(c) for c in held.fieldNames()])
    # A row that came in two batches may stand there twice.
    rows = state.select(F.inline(zipped)).distinct()
    rest = [c for c in rows.columns if c not in group]
    return latest(rows, n, group, tie=tie).select(*group, *rest)


class _Percents(StatefulProcessor):
    COLUMNS = ["seq", "done", "total", "percent"]

    def __init__(self, run: list[str], schema: T.StructType, ttl_ms: int | None):
        self.run, self.schema, self.ttl_ms = run, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        told = T.StructType([T.StructField("next", T.LongType()), T.StructField("percent", T.LongType())])
        early = T.StructType([T.StructField(c, T.LongType()) for c in self.COLUMNS])
        self.told = handle.getValueState("told", told, ttlDurationMs=self.ttl_ms)
        self.early = handle.getListState("early", _packed(early), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        to_do, percent = self.told.get() if self.told.exists() else (0, -1)
        come = [p[self.COLUMNS].to_numpy(dtype=np.int64) for p in rows]
        held = [np.array(list(e), dtype=np.int64).T for e in self.early.get()]
        waiting = np.unique(np.concatenate([*come, *held]), axis=0)
        waiting = waiting[waiting[:, 0] >= to_do]
        # The first row of each number, as far as the numbers go on without a gap.
        numbers, first = np.unique(waiting[:, 0], return_index=True)
        gaps = np.flatnonzero(numbers != to_do + np.arange(len(numbers)))
        n = int(gaps[0]) if len(gaps) else len(numbers)
        now = waiting[first[:n]]
        out = now[now[:, 3] != np.append(percent, now[:-1, 3])] if n else now
        to_do += n
        finished = n > 0 and bool(now[-1, 1] >= now[-1, 2])
        if finished:
            # The run is over: nothing of it is kept.
            self.told.clear()
            self.early.clear()
        else:
            self.told.update((to_do, int(now[-1, 3]) if n else percent))
            rest = waiting[waiting[:, 0] > to_do]
            if len(rest):
                self.early.put([tuple(c.tolist() for c in rest[at : at + PACK].T) for at in range(0, len(rest), PACK)])
            else:
                self.early.clear()
        if len(out):
            told = pd.DataFrame(out, columns=self.COLUMNS)
            for name, value in zip(self.run, key):
                told.insert(0, name, value)
            yield told[self.schema.fieldNames()]

    def close(self) -> None:
        pass


def percent_steps(progress: DataFrame, run: Sequence[str] = ("project_id", "migration_id"), ttl_ms: int | None = None) -> DataFrame:
    """The rows of a progress stream at which a run's whole percent changes.

    Rows of a run are numbered from 0 by ``seq``; ones that come early wait for
    those before them, so the answer does not depend on the order of arrival,
    and repeated ones change nothing. A run's state goes with its last row, and
    that of an abandoned one ``ttl_ms`` after it was last heard of (so does a
    row that comes once more after the end of its run).
    """
    run = [c for c in run if c in progress.columns]
    columns = [*run, *_Percents.COLUMNS]
    schema = T.StructType([progress.schema[c] if c in run else T.StructField(c, T.LongType()) for c in columns])
    rows = progress.select(*run, *[F.col(c).cast("long").alias(c) for c in _Percents.COLUMNS])
    return rows.groupBy(*run).transformWithStateInPandas(_Percents(run, schema, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")


def follow_percents(progress: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None, once: bool = False) -> StreamingQuery:
    """Append the rows of ``percent_steps`` to a Parquet folder."""
    _endless(ttl_ms, once)
    writer = percent_steps(progress, ttl_ms=ttl_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with _rocksdb(progress.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start(path)


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, object]:
    """Finished folders ``kind=n`` below ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = {}
    for entry in fs.listStatus(folder) if fs.exists(folder) else []:
        name = entry.getPath().getName()
        if name.startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = (fs, entry.getPath())
    return found


def read_changes(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    """Current rows of a table that ``changed_groups`` keeps: for each key the
    row of the last batch that changed it."""
    full = max(_folders(spark, path, "full"), default=-1)
    parts = [f"{path}/full={full}"] if full >= 0 else []
    parts += [f"{path}/changes={n}" for n in _folders(spark, path, "changes") if n > full and (upto is None or n <= upto)]
    if not parts:
        return spark.createDataFrame([], schema)
    placed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(placed).parquet(*parts)
    rest = [c for c in schema.fieldNames() if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("r"))
    return newest.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest], F.col("r.batch").alias("batch")).select(*schema.fieldNames(), "batch")


def changed_groups(aggregated: DataFrame, path: str, checkpoint: str, keys: Sequence[str], once: bool = False) -> StreamingQuery:
    """Keep the result of a streaming aggregate as a table of changes: a batch
    writes the groups it has changed and no others. Every COMPACT batches the
    changes are gathered into one folder and older folders go."""
    schema = aggregated.schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/changes={number}")
        if (number + 1) % COMPACT == 0:
            before = max(_folders(spark, path, "full"), default=-1)
            if before < number:
                read_changes(spark, path, schema, keys, number).write.mode("overwrite").parquet(f"{path}/full={number}")
            # Readers may still hold the folder before; what is older goes.
            for kind in ("full", "changes"):
                for n, (fs, old) in _folders(spark, path, kind).items():
                    if n < before or (kind == "changes" and n <= before):
                        fs.delete(old, True)

    writer = aggregated.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
