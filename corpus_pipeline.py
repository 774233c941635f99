"""From raw documents to packed training sequences, in five stages.

Each stage works on everything its predecessor kept and writes what it keeps
as Parquet; all but the last keep the columns of ``documents``. Decisions:
toxic documents go; later copies of repeated line runs are cut from the texts
(a document left without any text goes); of each group of near duplicates the
smallest id stays; documents that hold a benchmark item go; the rest is packed.
Rows without an id are kept, rows that repeat an id stand or fall together.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from satchel.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit_chain(docs, _table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_deleted") > 0) & (F.trim("text") == "")
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = jaccard_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(others.hint("merge"), docs["doc_id"] == others["doc_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id")
    return docs.join(leaks.hint("merge"), docs["doc_id"] == leaks["doc_id"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.measured(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

# A fitted classifier is not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written and reread."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
