"""One query per text operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcast.llm import (
    collocations,
    conversation_trie,
    decontamination,
    fingerprints,
    line_dedup,
    near_dedup,
    packing,
    repeated_bytes,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
    url_filters,
)
from starcast.llm.common import read_table
from starcast.session import materialize, shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Host, path and verdict of the rules of the URL query (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents with an estimate of a token per four characters, the revision to exact
    counts (committed twice, as after a failure), and the deletion of later copies. The first is folded into a snapshot."""
    docs = _documents(spark, sf_dir)
    files = {"byte_bpe_50k": RANKS, "words": ""}
    keyed = docs.withColumn("copy_of", F.xxhash64("text"))
    counts = materialize(token_counts.count_tokens(keyed, files, ("doc_id", "copy_of")), "counts")
    first = counts.groupBy("copy_of").agg(F.min("doc_id").alias("first"))
    copies = counts.join(first, "copy_of").where(F.col("doc_id") > F.col("first"))
    estimate = F.ceil(F.col("n_chars") / 4)
    store = shared_path(spark, "token_counts")
    token_counts.commit(token_counts.changes(counts, tokens=estimate), store, "insert")
    token_counts.fold(spark, store)
    for _ in range(2):
        token_counts.commit(token_counts.revisions(counts, estimate, "n_tokens"), store, "revise")
    token_counts.commit(token_counts.changes(copies, -1), store, "delete")
    return token_counts.totals(spark, store)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), RANKS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many lines go, how many characters stay, and a digest of what stays."""
    kept = F.coalesce("llm_kept_text", F.lit(""))
    return line_dedup.without_repeated_lines(_documents(spark, sf_dir)).select(
        "doc_id",
        F.col("llm_n_lines_removed").alias("n_lines_removed"),
        F.char_length(kept).cast("long").alias("n_kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_documents(spark, sf_dir), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_documents(spark, sf_dir))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filters.RULES)
    return url_filters.judge(read_table(spark, sf_dir, "pages"), rules)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    scored = toxicity.with_scores(docs.select("doc_id", "text"), labels, ~toxicity.held_out())
    return scored.select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("llm_score").alias("score"),
        (F.col("llm_score") >= 0.5).cast("int").alias("predicted"),
        F.col("llm_evidence").alias("evidence"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.without_repeats(_documents(spark, sf_dir)).drop("kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how many items it holds, their ids, and the least distance."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = decontamination.with_matches(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.size("llm_items").cast("long").alias("n_items"),
        F.array_join(F.col("llm_items.item_id"), ",").alias("items"),
        F.array_min("llm_items.distance").alias("least_distance"),
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations share up to three first turns with the one whose id is the last multiple of 20."""
    conv_id = F.col("conv_id")
    shared = F.crc32(conv_id.cast("string")) % 4
    conversations = read_table(spark, sf_dir, "conversations")
    found = conversation_trie.conversation_trie(conversations, shared, conv_id - conv_id % 20, most=3)
    return found.drop("enter", "leave")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_token_counts,
        op2_packing,
        op3_line_dedup,
        op4_near_dedup,
        op5_fingerprints,
        op6_url_filters,
        op7_toxicity,
        op8_suffix_dedup,
        op9_decontamination,
        op10_secret_scans,
        op11_conversation_trie,
        op12_collocations,
        op13_substring_dedup,
    )
}
