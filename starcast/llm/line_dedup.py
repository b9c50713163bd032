"""Deletes runs of lines that occurred before, found by winnowing over line hashes.

A run of whole lines with at least ``min_words`` words goes if the same lines stand at an earlier place, in this or another
document; that is, a line goes exactly if it lies in such a run, however far the run reaches. Lines compare without the white
space around them, and blank lines do not count.

A *window* is a shortest such run: from a line on, or up to a line. Of each window the line with the smallest hash, the
rightmost of equal ones, is selected as its fingerprint. Equal windows have equal fingerprints at equal places.

1. Fingerprints are counted over all documents. Only windows whose fingerprint occurs again stay.
2. Their positions are joined on the content of the window. The first, by document id and line, is the original; the others
   are matches.
3. Each match is extended both ways. Take any line of a repeated run: if enough words of the run follow it, the window from
   it on is repeated; if enough stand before it, so is the window up to it; else the window from the start of the run holds it.
   So the matched windows of both kinds together are the whole run, up to its first and last line, and all their lines go.

Documents are taken in the order of their ids, missing ids first.

Null or empty texts have no lines and stay. Rows that repeat both id and text are one document and get the same result.
Rows with the same id and other texts are ordered by a hash of the text. Long texts are handled whole; a window is kept
as a hash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from starcast.llm.common import text_key, texts
from starcast.session import materialize

MIN_WORDS = 20
WINDOWS = "doc_id long, text_key long, line int, n_lines int, fingerprint long, content binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def windows_of(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """First line, number of lines up to the last one, fingerprint and content hash of each window."""
    lines = [(i, line.strip()) for i, line in enumerate(text.split("\n"))]
    lines = [(i, line.encode(), len(line.split())) for i, line in lines if line]
    hashes = [xxh3_64_intdigest(line) for _, line, _ in lines]
    start = words = 0
    ends_from = [-1] * len(lines)
    for end, (_, _, own) in enumerate(lines):
        words += own
        while words - lines[start][2] >= min_words:
            # The window from a line on ends where its words first suffice.
            if ends_from[start] < 0:
                ends_from[start] = end
            words -= lines[start][2]
            start += 1
        if words >= min_words:
            if ends_from[start] < 0:
                ends_from[start] = end
            yield _window(lines, hashes, start, end)
    for start, end in enumerate(ends_from):
        # Windows up to a line were found above; those from a line on are others if a later start would do.
        if end >= 0 and sum(own for _, _, own in lines[start + 1 : end + 1]) >= min_words:
            yield _window(lines, hashes, start, end)


def _window(lines: list[tuple], hashes: list[int], start: int, end: int) -> tuple[int, int, int, bytes]:
    # Windows are short: at most min_words lines.
    fingerprint = min(reversed(hashes[start : end + 1]))
    content = xxh3_128_digest(b"\n".join(line for _, line, _ in lines[start : end + 1]))
    return lines[start][0], lines[end][0] - lines[start][0] + 1, _signed(fingerprint), content


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """The windows of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in WINDOWS.split(", ")]
        for batch in batches:
            rows = [
                (doc_id, key, *window)
                for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"])
                for window in windows_of(text, min_words)
            ]
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            yield frame.astype({"doc_id": "Int64", "text_key": "int64", "line": "int32", "n_lines": "int32"})

    return texts(docs).select("doc_id", text_key(), "text").mapInPandas(run, WINDOWS)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text_key`` and ``lines``: the sorted numbers of the lines to delete. Other documents are left out.

    Counts and first places are combined before the shuffle, and each later window is joined with one first place only,
    so a run that stands in very many documents makes as many rows as it has places.
    """
    found = materialize(windows(docs, min_words), "windows")
    again = found.groupBy("fingerprint").agg(F.count("line").alias("places")).where("places > 1")
    candidates = found.join(again, "fingerprint", "left_semi")
    place = F.struct("doc_id", "text_key", "line")
    first = candidates.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last")))
    later = candidates.join(first, "content").where(~place.eqNullSafe(F.col("first")))
    lines = later.select("doc_id", "text_key", F.explode(F.sequence("line", F.col("line") + F.col("n_lines") - 1)).alias("l"))
    return lines.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("l")).alias("lines"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, with ``llm_kept_text`` and ``llm_n_lines_removed``."""
    keyed = docs.withColumn("llm_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = repeated_lines(docs, min_words).toDF("llm_doc_id", "llm_key", "llm_lines")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("llm_doc_id")) & (F.col("llm_text_key") == F.col("llm_key"))
    gone = F.coalesce("llm_lines", F.array().cast("array<int>"))
    left = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return (
        keyed.join(lines, same, "left")
        .withColumn("llm_kept_text", F.when(F.col("llm_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
        .withColumn("llm_n_lines_removed", F.size(gone).cast("long"))
        .drop("llm_text_key", "llm_doc_id", "llm_key", "llm_lines")
    )
