"""The corpus pipeline: documents in, packed training sequences out. Each stage is one operator of ``starcast.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcast.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from starcast.llm.common import read_table
from starcast.session import shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5."""
    scored = toxicity.with_scores(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return scored.where("llm_score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without runs of lines that stood earlier; a document of which nothing is left goes."""
    cleaned = line_dedup.without_repeated_lines(docs)
    text = F.col("llm_kept_text")
    changed = F.col("llm_n_lines_removed") > 0
    columns = {"text": text, "n_chars": F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))}
    return cleaned.where(~changed | (F.trim(text) != "")).select(
        *[columns[name].alias(name) if name in columns else F.col(name) for name in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id: five words a shingle, a similarity of 0.8 or more."""
    found = near_dedup.near_duplicates(docs, k=5, percent=80).where("NOT kept")
    gone = found.select(F.col("doc_id").alias("llm_gone")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("llm_gone"), "left_anti")
    # Rows that repeat an id and a text are one document.
    return left.dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.with_matches(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("llm_items") == 0).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, RANKS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Vote scores, alignments and tokens are not for SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
