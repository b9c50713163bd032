"""Equi-joins that stay balanced when one key holds a large share of the rows.

``heavy_keys`` finds the keys with more rows than one task should take and says into how many blocks to cut each.
``lookup_join`` joins a fact with a side that has one row per key: the fact rows of a heavy key are dealt over its blocks
and the one matching row is copied to each block. ``blocked_join`` joins two sides that both repeat keys: the left rows
of a heavy key are cut into L blocks, the right rows into R, and each of the L x R cells is a separate join group.

All keys over the block size are listed, in a written table that is joined without a hint: Spark broadcasts a short list
and shuffles a long one. Results never depend on the list. Without one, both are plain joins, which adaptive execution
balances as far as it can; nothing is counted unless a caller asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcast.session import materialize, materialize_measured, row_count

ROWS_PER_LOOKUP_BLOCK = 500_000
# Both sides of a many-to-many join are cut, so a task never pairs more than the square of this for one key.
ROWS_PER_JOIN_BLOCK = 20_000


@dataclass(frozen=True)
class HeavyKeys:
    """Keys and their number of rows; ``table`` is None if no key has more than ``rows_per_block``."""

    keys: tuple[str, ...]
    rows_per_block: int
    table: DataFrame | None

    def renamed(self, *keys: str) -> HeavyKeys:
        table = None if self.table is None else self.table.toDF(*keys, "rows")
        return HeavyKeys(keys, self.rows_per_block, table)

    def plus(self, other: HeavyKeys) -> HeavyKeys:
        """Bounds for the rows of both counted tables together."""
        tables = [heavy.table for heavy in (self, other) if heavy.table is not None]
        if len(tables) == 2:
            both = tables[0].unionByName(tables[1]).groupBy(*self.keys).agg(F.sum("rows").alias("rows"))
        else:
            both = tables[0] if tables else None
        return HeavyKeys(self.keys, self.rows_per_block, both)

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` plus the number of blocks of its key as ``name``, 1 for keys that are not heavy."""
        blocks = F.ceil(F.col("rows") / self.rows_per_block).cast("int")
        listed = self.table.select(*[F.col(key).alias(f"__{key}") for key in self.keys], blocks.alias(name))
        # A missing key can be heavy too: it matches nothing, but a left join has to shuffle its rows.
        same = [F.col(key).eqNullSafe(F.col(f"__{key}")) for key in self.keys]
        return df.join(listed, same, "left").select(*df.columns, F.coalesce(name, F.lit(1)).alias(name))


def heavy_from_counts(
    counts: DataFrame, keys: Sequence[str], rows: str, rows_per_block: int, most: int | None = None
) -> HeavyKeys:
    """The heavy keys of a table that holds one row per key with its row count in ``rows``.

    ``most``: a bound for the counts, if known.
    """
    if most is not None and most <= rows_per_block:
        return HeavyKeys(tuple(keys), rows_per_block, None)
    listed = counts.where(F.col(rows) > rows_per_block).select(*keys, F.col(rows).cast("long").alias("rows"))
    table, measured = materialize_measured(listed, "heavy-keys", total=row_count())
    return HeavyKeys(tuple(keys), rows_per_block, table if measured["total"] else None)


def heavy_keys(
    df: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_LOOKUP_BLOCK, total: int | None = None
) -> HeavyKeys:
    """The heavy keys of ``df``. ``total``: its number of rows, if known; a table of one block is not counted."""
    if total is not None and total <= rows_per_block:
        return HeavyKeys(tuple(keys), rows_per_block, None)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return heavy_from_counts(counts, keys, "rows", rows_per_block)


def heavy_in_each(df: DataFrame, columns: Sequence[str], rows_per_block: int, total: int) -> list[HeavyKeys]:
    """The heavy keys of each of several columns of one type, counted in one pass."""
    if total <= rows_per_block:
        return [HeavyKeys((column,), rows_per_block, None) for column in columns]
    entries = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).alias("id")) for i, c in enumerate(columns)])
    counts = (
        df.select(F.explode(entries).alias("entry"))
        .groupBy(F.col("entry.column").alias("column"), F.col("entry.id").alias("id"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    heavy = heavy_from_counts(counts, ["column", "id"], "rows", rows_per_block).table
    if heavy is None:
        return [HeavyKeys((column,), rows_per_block, None) for column in columns]
    return [
        HeavyKeys(
            (column,), rows_per_block, heavy.where(F.col("column") == i).select(F.col("id").alias(column), "rows")
        )
        for i, column in enumerate(columns)
    ]


def heavy_in_pairs(df: DataFrame, keys: Sequence[str], total: int) -> list[HeavyKeys]:
    """The heavy keys of each of two columns and of both together, from one count of the pairs."""
    lists = [[key] for key in keys] + [list(keys)]
    if total <= ROWS_PER_LOOKUP_BLOCK:
        return [HeavyKeys(tuple(own), ROWS_PER_LOOKUP_BLOCK, None) for own in lists]
    counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "pair-counts")
    return [
        heavy_from_counts(
            counts.groupBy(*own).agg(F.sum("rows").alias("rows")), own, "rows", ROWS_PER_LOOKUP_BLOCK
        )
        for own in lists
    ]


def _deal(df: DataFrame, blocks: str) -> Column:
    """A block number for each row, the same if the task that reads the row is run again.

    The partition id spreads identical rows, which a hash of the row alone would keep together.
    """
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*hashable) + F.spark_partition_id(), F.col(blocks)).cast("int")


def _all_blocks(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    heavy: HeavyKeys | Sequence[HeavyKeys | None] | None = None,
) -> DataFrame:
    """Join ``fact`` with ``dim``, which holds at most one row per key.

    Without ``heavy`` this is the plain join. Several lists, each on a part of ``keys``, mean that a key is cut only if
    every list cuts it, and into the smallest number of blocks: each list bounds the rows of a key from above.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    lists = [heavy] if heavy is None or isinstance(heavy, HeavyKeys) else list(heavy)
    if any(heavy_list is None or heavy_list.table is None for heavy_list in lists):
        return fact.join(dim, list(keys), how)

    names = [f"__blocks_{i}" for i in range(len(lists))]
    blocks = F.least(*names) if len(names) > 1 else F.col(names[0])
    dealt, copied = fact, dim
    for heavy_list, name in zip(lists, names):
        dealt, copied = heavy_list.attach(dealt, name), heavy_list.attach(copied, name)
    dealt = dealt.withColumn("__blocks", blocks).withColumn("__block", _deal(fact, "__blocks"))
    copied = copied.withColumn("__blocks", blocks).withColumn("__block", _all_blocks("__blocks"))
    temporary = [*names, "__blocks"]
    return dealt.drop(*temporary).join(copied.drop(*temporary), [*keys, "__block"], how).drop("__block")


def blocked_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_heavy: HeavyKeys | None = None,
    right_heavy: HeavyKeys | None = None,
) -> DataFrame:
    """Inner join of two sides that may both repeat a key many times. A side without a list is not cut."""
    cuts = {
        side: heavy
        for side, heavy in [("__left", left_heavy), ("__right", right_heavy)]
        if heavy is not None and heavy.table is not None
    }

    def cut(df: DataFrame, own: str) -> DataFrame:
        columns = df.columns
        for side, heavy in cuts.items():
            df = heavy.attach(df, f"{side}_blocks")
            number = _deal(df.select(*columns), f"{side}_blocks") if side == own else _all_blocks(f"{side}_blocks")
            df = df.withColumn(side, number).drop(f"{side}_blocks")
        return df

    return cut(left, "__left").join(cut(right, "__right"), [*keys, *cuts]).drop(*cuts)


def repeat_rows(df: DataFrame, copies: str, most: int, rows_per_block: int = ROWS_PER_LOOKUP_BLOCK) -> DataFrame:
    """Each row as often as its ``copies`` says, at most ``most`` times.

    A row with very many copies is spread over several tasks.
    """
    if most == 1:
        return df.drop(copies)
    if most > rows_per_block:
        blocks = F.ceil(F.col(copies) / rows_per_block).cast("int")
        df = df.withColumn("__block", F.explode(F.sequence(F.lit(1), blocks)))
        left_over = F.col(copies) - (F.col("__block") - 1) * rows_per_block
        df = df.withColumn(copies, F.least(left_over, F.lit(rows_per_block))).repartition(*df.columns).drop("__block")
    return df.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(copies)
