"""Token counts kept up to date by signed changes.

A change says that so many documents, tokens and characters enter (+) or leave (-) one cell, that is a source, a
language and a version of the tokenizer. A revised count is the old count leaving and the new one entering. Totals are
sums of changes, so batches may be committed in any order.

A batch is written aside and becomes visible in one step, by renaming its folder to one that follows from its id. So a
batch counts once: a retry after a failure writes it anew, and a batch that is already there stays as it is. Maintained
totals are snapshots of all cells, each with the list of the batches in it: :func:`fold` adds the batches since the last
snapshot to it, and readers take the last snapshot and the batches behind it. Readers never see a part of a batch or of a
snapshot. One job at a time may commit a batch id, or fold.

Null source or language is a cell of its own. A null text counts as empty: one document without tokens. Repeated rows
are counted as often as they occur. An empty batch adds nothing; without any batch there are no totals. A cell whose
changes cancel out stays, with zeros. Batch ids may hold any characters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcast.llm.common import encoder
from starcast.llm.word_arrays import slices
from starcast.sources import folders

CELL = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"
#: Bytes of text that are Python strings at a time.
TEXT_AT_A_TIME = 1 << 20


def count_tokens(docs: DataFrame, rank_files: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and tokenizer version with its ``n_tokens`` and ``n_chars``, plus the columns ``carry``.

    ``rank_files``: the vocabulary file of each version; the version ``words`` counts runs between white space.
    """
    rows = docs.select(
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        *[F.col(name) for name in carry],
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = rows.drop("text").schema.add("n_chars", "long")
    for version in rank_files:
        schema = schema.add(f"n_{version}", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in slices(batch.column("text"), TEXT_AT_A_TIME):
                part = batch.slice(first, end - first)
                column = part.column("text")
                counts = [[] for _ in rank_files]
                for text in column:
                    text = text.as_py()
                    for own, (version, path) in zip(counts, rank_files.items()):
                        own.append(len(text.split() if version == "words" else encoder(path).encode_ordinary(text)))
                columns = [*part.columns[:-1], pc.utf8_length(column).cast(pa.int64())]
                columns += [pa.array(own, pa.int64()) for own in counts]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    counted = rows.mapInArrow(count, schema)
    versions = F.array(
        *[F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"n_{v}").alias("n_tokens")) for v in rank_files]
    )
    return counted.select("source", "lang", *carry, "n_chars", F.inline(versions))


def changes(counts: DataFrame, sign: int | Column = 1, tokens: str | Column = "n_tokens") -> DataFrame:
    """Counts of documents as changes: ``sign`` 1 for documents that enter, -1 for those that leave."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return counts.select(
        *CELL,
        sign.cast("long").alias("n_docs"),
        (sign * tokens).cast("long").alias("n_tokens"),
        (sign * F.col("n_chars")).cast("long").alias("n_chars"),
    )


def revisions(counts: DataFrame, old: str | Column, new: str | Column) -> DataFrame:
    """Changes for documents that stay while their token count goes from ``old`` to ``new``."""
    return changes(counts, -1, old).unionByName(changes(counts, 1, new))


def roll_up(rows: DataFrame) -> DataFrame:
    """One row per cell. The sums are combined before the shuffle, so a cell with most of the rows is no hot spot."""
    return rows.groupBy(*CELL).agg(*[F.sum(name).alias(name) for name in SUMS])


def _folder(batch_id: str) -> str:
    return hashlib.sha256(batch_id.encode()).hexdigest()


def _aside(store: str) -> str:
    return f"{store}/_aside/{uuid.uuid4().hex}"


def commit(rows: DataFrame, store: str, batch_id: str) -> bool:
    """Store the changes of a batch, unless it is stored already; whether this call stored it."""
    spark = rows.sparkSession
    place = f"{store}/batches/{_folder(batch_id)}"
    if folders.exists(spark, place):
        return False
    aside = _aside(store)
    try:
        roll_up(rows).write.parquet(aside)
        return folders.rename(spark, aside, place)
    finally:
        folders.remove(spark, aside)


def _cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.schema(SCHEMA)
    return rows.parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def _current(spark: SparkSession, store: str) -> tuple[int, list[str], set[str]]:
    """The number of the last snapshot, the folders that make up the totals, and the batches within them."""
    snapshots = folders.names(spark, f"{store}/totals")
    batches = folders.names(spark, f"{store}/batches")
    if not snapshots:
        return 0, [f"{store}/batches/{name}" for name in batches], set(batches)
    last = f"{store}/totals/{snapshots[-1]}"
    folded = {row["batch"] for row in spark.read.schema("batch string").parquet(f"{last}/folded").collect()}
    since = [f"{store}/batches/{name}" for name in batches if name not in folded]
    return int(snapshots[-1]), [f"{last}/cells", *since], folded | set(batches)


def fold(spark: SparkSession, store: str) -> int:
    """Write the next snapshot of the totals, with all batches committed by now; returns its number.

    The names of the batches pass through the driver, their rows do not. Without new batches nothing is written.
    """
    number, paths, batches = _current(spark, store)
    if len(paths) <= (number > 0):
        return number
    aside = _aside(store)
    try:
        roll_up(_cells(spark, paths)).write.parquet(f"{aside}/cells")
        spark.createDataFrame([(name,) for name in sorted(batches)], "batch string").coalesce(1).write.parquet(f"{aside}/folded")
        if not folders.rename(spark, aside, f"{store}/totals/{number + 1:010d}"):
            raise OSError(f"snapshot {number + 1} of {store} exists already")
    finally:
        folders.remove(spark, aside)
    return number + 1


def totals(spark: SparkSession, store: str) -> DataFrame:
    """The current counts of all cells: the last snapshot and the batches committed since."""
    return roll_up(_cells(spark, _current(spark, store)[1]))
