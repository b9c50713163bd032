"""What the text operators share: whole texts with a key, and the vocabulary on the workers."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The split before the merges of the public byte-level vocabularies (fixed value).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Texts that are turned into strings, and sent back, at a time: a batch of Arrow data may hold many more.
ROWS_AT_A_TIME = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every row; a null text is empty. All other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def text_key() -> Column:
    """Tells the rows of one ``doc_id`` apart. Rows that repeat both id and text are the same document."""
    return F.xxhash64("text").alias("text_key")


@lru_cache(maxsize=4)
def encoder(path: str):
    """The vocabulary of a rank file, once per worker. Markers such as ``<|endoftext|>`` in a text are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def append_columns(
    docs: DataFrame, added: list[tuple[str, str]], compute: Callable[[], Callable[[list[str]], list[list]]]
) -> DataFrame:
    """``docs`` with all its rows and columns, and columns computed from the texts, a null text being empty.

    ``compute`` is called once per task and returns a function from some texts, at most ``ROWS_AT_A_TIME`` of a batch, to
    the values of each added column. The other columns pass through as Arrow data, so no type or null changes. ``added`` holds names and types.
    """
    new_fields = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added))
    schema = StructType([*docs.schema.fields, *new_fields.fields])
    types = to_arrow_schema(new_fields)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(first, ROWS_AT_A_TIME)
                values = function([text or "" for text in part.column(place).to_pylist()])
                new = [pa.array(column, field.type) for column, field in zip(values, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)
