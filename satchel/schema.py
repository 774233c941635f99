"""Row types shared by sources, operators and plans."""

from __future__ import annotations

from pyspark.sql import types as T

META = T.MapType(T.StringType(), T.StringType())
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCUMENT = _struct(id=T.StringType(), content=T.StringType(), meta=META)

# Stored row. The metadata keys every listing or sync touches are columns so
# that scans prune to them; ``meta`` keeps whatever else the caller attached.
POINT = _struct(
    project_id=T.StringType(),
    id=T.StringType(),
    content=T.StringType(),
    source_file=T.StringType(),
    source_dir=T.StringType(),
    chunk_index=T.StringType(),
    content_hash=T.StringType(),
    chunk_version=T.StringType(),
    doc_id=T.StringType(),
    meta=META,
    embed_model=T.StringType(),
    embed_dim=T.IntegerType(),
    embedding=VECTOR,
)

POSTING = _struct(
    project_id=T.StringType(),
    id=T.StringType(),
    term=T.StringType(),
    tf=T.LongType(),
    positions=T.ArrayType(T.IntegerType()),
)

FILE = _struct(
    project_id=T.StringType(),
    source_dir=T.StringType(),
    rel_path=T.StringType(),
    length=T.LongType(),
    text=T.StringType(),
)

QUERY = _struct(
    query_id=T.StringType(),
    project_id=T.StringType(),
    query=T.StringType(),
    qvec=VECTOR,
    k=T.IntegerType(),
    recall=T.IntegerType(),
    hybrid=T.BooleanType(),
    rerank=T.BooleanType(),
    compress=T.BooleanType(),
)

RERANK_HIT = _struct(
    query_id=T.StringType(),
    hit=T.IntegerType(),
    idx=T.IntegerType(),
    relevance_score=T.DoubleType(),
)

# ``event_id`` orders rows of one time; ``latency_ms`` is a question's share of
# its batch, ``batch_ms`` what the whole batch of ``batch_queries`` took.
QUERY_LOG = _struct(
    event_id=T.LongType(),
    ts=T.TimestampType(),
    project_id=T.StringType(),
    latency_ms=T.DoubleType(),
    hybrid=T.BooleanType(),
    reranked=T.BooleanType(),
    candidates=T.IntegerType(),
    results=T.IntegerType(),
    dense_count=T.IntegerType(),
    lexical_count=T.IntegerType(),
    rerank_moved=T.IntegerType(),
    batch_id=T.StringType(),
    batch_ms=T.DoubleType(),
    batch_queries=T.LongType(),
)

EVENT = _struct(
    event_id=T.LongType(),
    type=T.StringType(),
    ts=T.TimestampType(),
    project_id=T.StringType(),
    data=META,
)

USAGE = _struct(ts=T.TimestampType(), stage=T.StringType(), model=T.StringType(), tokens=T.LongType())

# Metadata keys held as columns of POINT.
COLUMN_KEYS = ("source_file", "source_dir", "chunk_index", "content_hash", "chunk_version", "doc_id")
