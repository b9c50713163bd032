"""Collocations of two to four words by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces, and those at spaces and tabs into words. The
suffixes of a piece are sorted by their first ``MOST`` words; the size of a partition of equal ones is the count of the
phrase they begin with. On a cluster:

1. *Global routing.* Words, and leading pairs of words, are counted over all texts of a language by bucket of hash, with
   equal ones of a slice combined before the shuffle. Pairs below ``least`` are abandoned: no phrase with them can reach it.
   A bitmap of fixed size tells the tasks which pairs are left; a pair that only shares a bit is abandoned later.
2. *Partitions.* Suffix pointers with a leading pair that is left go to its bucket, cut before their first pair that is
   not. Each bucket is sorted by multikey three-way quicksort down to ``MOST`` words; partitions below ``least`` are
   abandoned. A bucket that is too large for a task is cut into cells; their partition sizes are summed before the cut.
3. *Scores.* First and last parts of a phrase are phrases or words themselves, so joins on them give ``l`` and ``r``. A
   phrase goes if a longer one around it occurs in nearly all its places.
4. *Words.* Only phrases that can be in the result are spelled out, from one more pass that collects their words.

Null text is empty; null language is ``und``. Copies of a row count as often as they occur; ids do not matter. Words of
any length are handled whole. Of cuts with one score the shortest first part counts; of phrases with one score the more
frequent, then the first in byte order. Without texts, or frequent phrases, the result is empty. Other columns than
``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcast.llm.word_arrays import binary_array, hash_words, numbers, pair, runs, separators, slices
from starcast.operators.skew import heavy_from_counts
from starcast.session import materialize, materialize_measured

MOST, LEAST, PERCENT, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
#: Bytes of text that are counted together, bytes of text for each bucket of pairs, and suffixes for each bucket or cell.
SLICE, TEXT_PER_BUCKET, SUFFIXES_PER_BUCKET = 4 << 20, 12 << 20, 1 << 20
#: Bits of the map of what is left: two megabytes at any size of the corpus.
MAP_BITS = 24
SALTS = 32
CUTS = separators(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
BETWEEN = CUTS | separators((0x20, 0x20), (0x09, 0x09))
LEADING = "bucket int, keys binary, counts binary"
SUFFIXES = "bucket int, lang string, words binary, counts binary"
PHRASES = "lang string, words array<long>, a long"
_ONE = np.uint64(1)


def _words(batch: pa.RecordBatch, first: int, end: int, data: np.ndarray, bounds: np.ndarray) -> tuple:
    """Words of a slice (odd numbers), whether the next one follows in the same piece, the hash of both (even), the rows
    and first bytes."""
    words, starts, row = hash_words(data, bounds, BETWEEN, lower=True)
    langs = batch.column("lang_key").to_numpy()[first:end].view(np.uint64)
    words = pair(words, langs[row]) | _ONE
    cuts = np.cumsum(CUTS[data], dtype=np.int64)[starts]
    joined = (row[1:] == row[:-1]) & (cuts[1:] == cuts[:-1])
    return words, joined, pair(words[:-1], words[1:]) & ~_ONE, row, starts


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)


def _bucket_column(n_buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned("key", 40), F.lit(n_buckets)).cast("int")


def _leading(n_buckets: int):
    """Counts of the words, of the pairs of words and of all words of a language, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang_key").to_numpy().view(np.uint64) | _ONE
            for part in slices(batch.column("text"), SLICE):
                words, joined, pairs, row, _ = _words(batch, *part)
                keys, counts = np.unique(np.concatenate([words, pairs[joined]]), return_counts=True)
                of_lang, inverse = np.unique(langs[part[0] : part[1]], return_inverse=True)
                total = np.bincount(inverse[row], minlength=len(of_lang))
                keys, counts = np.append(keys, of_lang), np.append(counts, total)
                bucket = _bucket(keys, n_buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, counts = bucket[order], keys[order], counts[order].astype(np.int32)
                edges = runs(bucket)
                columns = [pa.array(bucket[edges[:-1]]), binary_array(keys, edges), binary_array(counts, edges)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts"])

    return run


def _frequent(least: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate(numbers(table["keys"], np.uint64))
        counts = np.concatenate(numbers(table["counts"], np.int32)).astype(np.int64)
        order = np.argsort(keys)
        keys = keys[order]
        edges = runs(keys)
        sums = np.add.reduceat(counts[order], edges[:-1]) if len(keys) else counts
        kept = sums >= least
        return pa.table({"key": keys[edges[:-1]][kept].view(np.int64), "n": sums[kept]})

    return run


def _bitmap(keys: DataFrame) -> Broadcast:
    """A bit for each value of the low ``MAP_BITS`` bits of a key, set if a key has it."""
    slot = F.col("key").bitwiseAND((1 << MAP_BITS) - 1)
    parts = (
        keys.groupBy(F.shiftright(slot, 15).alias("part"))
        .agg(F.expr(f"bitmap_construct_agg((key & {(1 << MAP_BITS) - 1}) & 32767)").alias("bits"))
        .collect()
    )
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for part, piece in parts:
        bits[part * 4096 : part * 4096 + 4096] = np.frombuffer(bytes(piece), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _suffixes(left: Broadcast, n_buckets: int):
    """Suffix pointers whose leading pair is left, as their first words up to a pair that is not, with zeros behind.
    Equal ones of a slice are combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in slices(batch.column("text"), SLICE):
                words, joined, pairs, row, _ = _words(batch, *part)
                follows = np.zeros(len(words) + MOST, bool)
                follows[: len(joined)] = joined
                follows[: len(joined)][joined] = _marked(left.value, pairs[joined])
                at = np.flatnonzero(follows)
                padded = np.append(words, np.zeros(MOST, np.uint64))
                held, going = [padded[at]], np.ones(len(at), bool)
                for depth in range(1, MOST):
                    going = going & follows[at + depth - 1]
                    held.append(np.where(going, padded[at + depth], np.uint64(0)))
                whole = pair(pair(held[0], held[1]), pair(held[2], held[3]))
                _, one, counts = np.unique(whole, return_index=True, return_counts=True)
                codes = {lang: code for code, lang in enumerate(dict.fromkeys(langs[part[0] : part[1]]))}
                lang = np.array([codes[lang] for lang in langs[part[0] : part[1]]], np.int64)[row[at[one]]]
                bucket = _bucket(pairs[at[one]], n_buckets)
                order = np.lexsort((pairs[at[one]], lang, bucket))
                one, counts, lang, bucket = one[order], counts[order].astype(np.int32), lang[order], bucket[order]
                edges = runs(bucket.astype(np.int64) * len(codes) + lang)
                # Column by column, since the first words of neighbours are alike.
                words_of = [
                    np.concatenate([column[one[a:b]] for column in held]).tobytes() for a, b in zip(edges[:-1], edges[1:])
                ]
                names = list(codes)
                columns = [
                    pa.array(bucket[edges[:-1]]),
                    pa.array([names[code] for code in lang[edges[:-1]]], pa.string()),
                    pa.array(words_of, pa.binary()),
                    binary_array(counts, edges),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "words", "counts"])

    return run


def quicksort(columns: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of suffix pointers. ``columns``: the first, second, ... word of each, 0 for none.

    Yields a pointer, a number of words and a count for each partition of pointers that are equal in that many words and
    whose count is at least ``least``. Smaller partitions are abandoned unsorted.
    """
    stack = [(np.arange(len(counts)), 0)]
    while stack:
        pointers, depth = stack.pop()
        if not len(pointers) or counts[pointers].sum() < least:
            continue
        words = columns[depth][pointers]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        same = words == pivot
        equal = pointers
        if not same.all():
            below = words < pivot
            equal = pointers[same]
            stack += [(pointers[below], depth), (pointers[~below & ~same], depth)]
        count = int(counts[equal].sum())
        if pivot and count >= least:
            yield int(equal[0]), depth + 1, count
            if depth + 1 < len(columns):
                stack.append((equal, depth + 1))


def _sort(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = [words.reshape(MOST, -1) for words in numbers(table["words"], np.uint64)]
        langs = np.repeat(np.arange(len(rows)), [words.shape[1] for words in rows])
        columns = list(np.concatenate(rows, axis=1))
        counts = np.concatenate(numbers(table["counts"], np.int32)).astype(np.int64)
        names = table["lang"].to_pylist()
        # A cell holds a part of the suffixes, so its partitions may be parts of frequent ones.
        found = [f for f in quicksort(columns, counts, least if key[2].as_py() == 1 else 1) if f[1] > 1]
        words = np.stack(columns, axis=1).view(np.int64)
        return pa.table(
            {
                "lang": pa.array([names[langs[p]] for p, _, _ in found], pa.string()),
                "words": pa.array([words[p, :size].tolist() for p, size, _ in found], pa.list_(pa.int64())),
                "a": pa.array([count for _, _, count in found], pa.int64()),
            }
        )

    return run


def phrases(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of ``lang`` with a count ``a`` of at least ``least``, as hashes of ``words``, and the frequent keys
    (words, pairs and languages) with their count ``n``."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 + size // TEXT_PER_BUCKET
    counted = texts.mapInArrow(_leading(n_buckets), LEADING)
    leading = materialize(counted.groupBy("bucket").applyInArrow(_frequent(least), "key long, n long"), "leading")
    pairs = leading.where("key & 1 = 0")
    n_buckets = 1 + (pairs.agg(F.sum("n")).first()[0] or 0) // SUFFIXES_PER_BUCKET
    loads = pairs.groupBy(_bucket_column(n_buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    heavy = heavy_from_counts(loads, ["bucket"], "n", 2 * SUFFIXES_PER_BUCKET)
    suffixes = texts.mapInArrow(_suffixes(_bitmap(pairs), n_buckets), SUFFIXES)
    if heavy.table is None:
        suffixes = suffixes.withColumns({"cells": F.lit(1), "cell": F.lit(0)})
    else:
        cell = F.expr("cast(pmod(xxhash64(words, counts), cells) as int)")
        suffixes = heavy.attach(suffixes, "cells").withColumn("cell", cell)
    found = suffixes.groupBy("bucket", "cell", "cells").applyInArrow(_sort(least), PHRASES)
    if heavy.table is not None:
        found = found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return materialize(found, "phrases"), leading


def _parts(column: str, sizes: str) -> Column:
    """All contiguous parts of a phrase with two words or more, but not itself."""
    return F.expr(
        f"flatten(transform(sequence(2, {sizes} - 1), k -> transform(sequence(1, {sizes} - k + 1), i -> slice({column}, i, k))))"
    )


def scored(found: DataFrame, leading: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer one takes the place of, with ``l``, ``r`` and ``score`` of their lowest cut."""
    longer = found.where("size(words) > 2").select(F.explode(_parts("words", "size(words)")).alias("words"), "a")
    longer = longer.groupBy("words").agg(F.max("a").alias("most"))
    kept = found.join(longer, "words", "left").where(
        F.col("most").isNull() | (F.expr("cast(100 as decimal(38,0)) * most") < F.expr(f"cast({percent} as decimal(38,0)) * a"))
    )
    cuts = kept.select("lang", "words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).withColumns(
        {"head": F.expr("slice(words, 1, k)"), "tail": F.expr("slice(words, k + 1, size(words) - k)")}
    )
    counts = found.select("words", F.col("a").alias("n")).unionByName(
        leading.where("key & 1 = 1").select(F.array("key").alias("words"), "n")
    )
    cuts = cuts.join(counts.toDF("head", "l"), "head").join(counts.toDF("tail", "r"), "tail")
    # Exact beyond 64 bits; the quotient is at most half of SCALE.
    score = F.expr(f"cast(({SCALE} * cast(a as decimal(28,0))) div (cast(l as decimal(20,0)) + r) as long)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("lowest")
    return cuts.groupBy("lang", "words", "a").agg(lowest).select("lang", "words", "a", "lowest.l", "lowest.r", "lowest.score")


def _first(df: DataFrame, number: Column, order: list[Column], top: int) -> DataFrame:
    """The rows of each language with a number up to ``top``, first of each share of a language, then of all shares."""
    shares = df.withColumn("salt", F.expr(f"pmod(xxhash64(words), {SALTS})"))
    shares = shares.withColumn("rank", number.over(Window.partitionBy("lang", "salt").orderBy(*order)))
    left = shares.where(F.col("rank") <= top).drop("salt")
    return left.withColumn("rank", number.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top
    )


def _spelled(wanted: Broadcast):
    """The words whose key is marked, each once a task as far as memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch.column("text"), SLICE):
                data, bounds = part[2], part[3]
                words, _, _, row, starts = _words(batch, *part)
                some = np.flatnonzero(_marked(wanted.value, words))
                keys, one = np.unique(words[some], return_index=True)
                if len(seen) > 1 << 20:
                    seen.clear()
                new = np.array([int(key) not in seen for key in keys], bool)
                seen.update(keys[new].tolist())
                keys, at = keys[new], some[one[new]]
                gaps = np.append(np.flatnonzero(BETWEEN[data]), len(data))
                ends = np.minimum(gaps[np.searchsorted(gaps, starts[at])], bounds[row[at] + 1])
                spelled = [data[a:b].tobytes().lower().decode() for a, b in zip(starts[at], ends)]
                columns = [pa.array(keys.view(np.int64)), pa.array(spelled, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word"])

    return run


def collocations(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the first ``top`` phrases of each
    language."""
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("lang_key", F.xxhash64("lang"))
    found, leading = phrases(texts, least)
    order = [F.desc("score"), F.desc("a")]
    best, measured = materialize_measured(
        _first(scored(found, leading, percent), F.rank(), order, top).drop("rank"), "best", rows=F.count(F.lit(1))
    )
    used = best.select(F.explode("words").alias("key")).distinct()
    words = texts.mapInArrow(_spelled(_bitmap(used)), "key long, word string").groupBy("key").agg(F.min("word").alias("word"))
    places = best.select("lang", "words", F.posexplode("words").alias("place", "key")).join(words, "key")
    spelled = places.groupBy("lang", "words").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("found"))
    named = best.join(spelled, ["lang", "words"]).withColumn("phrase", F.array_join(F.col("found.word"), " "))
    totals = leading.where("key & 1 = 1").select(F.col("key").alias("lang_key"), "n")
    ranked = _first(named, F.row_number(), [*order, F.asc("phrase")], top)
    return ranked.withColumn("lang_key", F.xxhash64("lang").bitwiseOR(F.lit(1))).join(totals, "lang_key").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
