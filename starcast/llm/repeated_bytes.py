"""Removes every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere, by distributed prefix doubling.

Prefix doubling ranks all positions by their first bytes, then by pairs of ranks at growing offsets, until a position is
unique or ranked beyond the threshold. Two changes make it fit for large inputs:

* *Names instead of ranks.* The name of 2n bytes is a 64-bit hash of the names of their halves, so texts are ranked where
  they lie; shuffles only find out which names occur more than once. Names that decide are compared within equal names
  of shorter strings, so two hashes must agree.
* *Sampled positions.* Each string of ``LENGTH`` bytes has an anchor: the position in it whose ``SEED`` bytes have the
  smallest name, of equal ones the rightmost. Equal strings have equal anchors at equal places. Only anchors, about one
  in 70 positions, are shuffled, each with the strings that it stands for: they start at consecutive positions.

Rounds:

1. Anchors by the name of their ``SEED`` bytes. Unique ones are done: their strings stand nowhere else.
2. Those left by all bytes that their strings cover. If these occur again, so do all the strings.
3. One anchor for each other such context goes on: its strings in blocks of ``BLOCK`` starts, by the name of the bytes
   that all strings of a block share, then by those that the block covers.
4. The strings of blocks that are still undecided, one by one, by the few bytes that they hold beside the shared ones.

No round compares pairs, and what a name needs is a count, a least and a largest value, combined before the shuffle.

Null and empty texts, and those of less than ``LENGTH`` bytes, lose nothing. Every row is a document of its own: a text
that two rows hold occurs twice, whether or not their ids agree. Missing ids come back as missing. Texts are handled
whole, in pieces of bounded size. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.operators.skew import heavy_from_counts, lookup_join
from starcast.session import materialize

LENGTH, SEED, HALF = 200, 32, 128
BLOCK = 16
#: The bytes that all strings of a block have in common.
SHARED = LENGTH - BLOCK + 1
PIECE = 1 << 21
#: Rows of one name that one task joins.
ROWS_PER_BLOCK = 20_000
ANCHORS = "name long, context long, id long, text_key long, place long"
BLOCKS = "name long, context long, id long, text_key long, start long, starts long, behind long, left binary, right binary"
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        mixed = (mixed ^ part.astype(np.uint64)) * _A
        mixed ^= mixed >> np.uint64(32)
        mixed *= _B
        mixed ^= mixed >> np.uint64(29)
    return mixed


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the ``SEED`` and of the ``HALF`` bytes at each position."""
    name = (data.astype(np.uint64) + np.uint64(1)) * _C
    name ^= name >> np.uint64(31)
    length, seed = 1, name
    while length < HALF:
        name = name[:-length] * _A + name[length:] * _B
        name ^= name >> np.uint64(30)
        length *= 2
        if length == SEED:
            name = _mix(name)
            seed = name
    return seed, _mix(name)


def anchors_of(seed: np.ndarray, n_strings: int) -> np.ndarray:
    """The anchor of the string at each start: the rightmost least name in it, by doubling the range of the minimum."""
    width = LENGTH - SEED + 1
    least, at = seed[: n_strings + width - 1], np.arange(n_strings + width - 1)
    reach = 1

    def step(by: int) -> None:
        nonlocal least, at
        right = least[by:] <= least[:-by]
        at = np.where(right, at[by:], at[:-by])
        least = np.where(right, least[by:], least[:-by])

    while 2 * reach <= width:
        step(reach)
        reach *= 2
    if reach < width:
        step(width - reach)
    return at


def cover(half: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of ``length`` bytes (128 to 384) at each start, from three names of ``HALF`` bytes that cover them."""
    last = length - HALF
    return _mix(half[start], half[start + np.minimum(last, HALF)], half[start + last], length)


def pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text, each with the strings that start in ``PIECE`` positions, and where they begin."""
    for begin in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield begin, np.frombuffer(data, np.uint8)[begin : begin + PIECE + LENGTH - 1]


def _anchor_rows(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Name, context and place of the anchors of a text. A place holds the first start, how many starts follow it and
    how far behind the first start the anchor lies."""
    for begin, part in pieces(data):
        seed, half = names(part)
        at = anchors_of(seed, len(part) - LENGTH + 1)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        more = np.diff(np.append(first, len(at))) - 1
        behind = at[first] - first
        context = _mix(cover(half, first, more + LENGTH), behind)
        yield seed[at[first]], context, ((first + begin) << 16) | (more << 8) | behind


def anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            size = 0
            for id_, key, text in zip(batch["id"].tolist(), batch["text_key"].tolist(), batch["text"]):
                for name, context, place in _anchor_rows(text.encode("utf-8", "surrogatepass")):
                    n = len(name)
                    found.append((name, context, np.full(n, id_), np.full(n, key), place))
                    size += n
                    if size >= 200_000:
                        yield _rows(found, ANCHORS)
                        found, size = [], 0
            yield _rows(found, ANCHORS)

    return docs.select("id", "text_key", "text").mapInPandas(run, ANCHORS)


def _rows(found: list[tuple], schema: str) -> pd.DataFrame:
    columns = [field.split()[0] for field in schema.split(", ")]
    joined = [np.concatenate(part).view(np.int64) for part in zip(*found)] or [np.empty(0, np.int64)] * len(columns)
    return pd.DataFrame(dict(zip(columns, joined)))


def _spread(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a key of ``counted``, which says in ``n`` how many each has. Those of a frequent key are spread."""
    heavy = heavy_from_counts(counted, keys, "n", ROWS_PER_BLOCK)
    return lookup_join(rows, counted.drop("n"), keys, heavy=heavy)


def repeats(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Of rows with a ``name`` and the ``context`` it stands in: those whose context occurs again, and one row for each
    context whose name occurs again in another one."""
    counted = rows.groupBy("name").agg(
        F.count("context").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    counted = materialize(counted.where("n > 1"), f"{label}-names")
    marked = _spread(rows, counted, ["name"]).withColumn("single", F.expr("low = high"))
    marked = materialize(marked.drop("low", "high"), label)
    several = marked.where("NOT single").drop("single")
    other = [c for c in several.columns if c not in ("name", "context")]
    contexts = several.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*other)).alias("one")
    )
    contexts = materialize(contexts, f"{label}-contexts")
    again = _spread(several, contexts.where("n > 1").select("name", "context", "n"), ["name", "context"])
    whole = marked.where("single").drop("single").unionByName(again.select(*several.columns))
    return whole, contexts.select("name", "context", "one.*")


def blocks(docs: DataFrame, undecided: DataFrame) -> DataFrame:
    """The blocks of strings of undecided anchors, by the name of what the strings of a block share."""
    listed = undecided.groupBy("id", "text_key").agg(F.collect_list(F.struct("name", "place")).alias("anchors"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[pd.DataFrame] = []
            size = 0
            for id_, key, text, own in zip(batch["id"], batch["text_key"], batch["text"], batch["anchors"]):
                named = np.array([anchor["name"] for anchor in own], np.int64)
                places = np.array([anchor["place"] for anchor in own], np.int64)
                for frame in _blocks_of(text.encode("utf-8", "surrogatepass"), named, places):
                    made.append(frame.assign(id=id_, text_key=key))
                    size += len(frame)
                if size >= 20_000:
                    yield pd.concat(made)
                    made, size = [], 0
            if made:
                yield pd.concat(made)

    rows = docs.select("id", "text_key", "text").join(listed, ["id", "text_key"])
    return rows.mapInPandas(run, BLOCKS)


def _blocks_of(data: bytes, named: np.ndarray, places: np.ndarray) -> Iterator[pd.DataFrame]:
    """The blocks of the anchors of one text, piece by piece."""
    order = np.argsort(places, kind="stable")
    named, places = named[order], places[order]
    first, more, behind = places >> 16, (places >> 8) & 255, places & 255
    for piece in np.unique(first // PIECE):
        here = first // PIECE == piece
        begin = int(piece) * PIECE
        _, half = names(np.frombuffer(data, np.uint8)[begin : begin + PIECE + 2 * LENGTH])
        # All strings, with the number of their anchor and how far behind them it lies.
        count = more[here] + 1
        anchor = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(anchor)) - np.repeat(np.cumsum(count) - count, count) + (first[here] - begin)[anchor]
        back = (first[here] - begin + behind[here])[anchor] - start
        # Blocks count from the anchor, so equal strings lie in equal blocks.
        block = back // BLOCK
        edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])))
        low, high = start[edge], start[np.append(edge[1:], len(anchor)) - 1]
        # Every string of a block holds the bytes from the block's last possible start to the end of its first one.
        shared = low + back[edge] - BLOCK * block[edge]
        end = shared + SHARED
        common = _mix(named[here][anchor[edge]], block[edge], cover(half, shared, np.full(len(edge), SHARED)))
        whole = _mix(common, back[edge], cover(half, low, high - low + LENGTH))
        yield pd.DataFrame(
            {
                "name": common.view(np.int64),
                "context": whole.view(np.int64),
                "start": low + begin,
                "starts": high - low + 1,
                "behind": back[edge] - BLOCK * block[edge],
                "left": [data[i:j] for i, j in zip((low + begin).tolist(), (shared + begin).tolist())],
                "right": [data[i:j] for i, j in zip((end + begin).tolist(), (high + LENGTH + begin).tolist())],
            }
        )


def covered(docs: DataFrame) -> DataFrame:
    """``id``, ``text_key``, ``start`` and ``starts``: runs of starts of strings that occur again."""
    whole, undecided = repeats(materialize(anchors(docs), "all-anchors"), "anchors")
    place = F.col("place")
    runs = whole.select(
        "id", "text_key", F.shiftright(place, 16).alias("start"), F.expr("((place >> 8) & 255) + 1").alias("starts")
    )
    made = materialize(blocks(docs, undecided), "blocks")
    same, open_blocks = repeats(made, "same_blocks")
    runs = runs.unionByName(same.select("id", "text_key", "start", "starts"))
    # The string that starts i bytes behind its block's start lacks i bytes on the left and has i more on the right.
    single = open_blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("starts").cast("int") - 1))).select(
        "name",
        (F.col("behind") - F.col("i")).alias("behind"),
        F.expr("substring(left, i + 1)").alias("left"),
        F.expr(f"substring(right, 1, {BLOCK - 1} - behind + i)").alias("right"),
        "id",
        "text_key",
        (F.col("start") + F.col("i")).alias("start"),
        F.lit(1).cast("long").alias("starts"),
    )
    string = ["name", "behind", "left", "right"]
    twice = materialize(single.groupBy(*string).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "same_strings")
    return runs.unionByName(_spread(single, twice, string).select(*runs.columns))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept`` (the bytes) of every row."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("text_key"),
        F.col("doc_id").isNotNull().alias("present"),
        text.alias("text"),
    )
    runs = covered(keyed)
    listed = runs.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "starts")).alias("runs"))
    joined = keyed.join(listed, ["id", "text_key"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for present, id_, text, runs in zip(batch["present"], batch["id"], batch["text"], batch["runs"]):
                data = text.encode("utf-8", "surrogatepass")
                kept, removed, spans = cut(data, [] if runs is None else [(r["start"], r["starts"]) for r in runs])
                rows.append((id_ if present else None, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(rows, columns=[field.split()[0] for field in schema.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return joined.select("present", "id", "text", "runs").mapInPandas(run, schema)


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes that no string covers, how many go, and in how many runs."""
    kept, removed, spans, end = [], 0, 0, 0
    for start, starts in sorted(runs):
        stop = start + starts - 1 + LENGTH
        if start > end or not spans:
            kept.append(data[end:start])
            spans += 1
            end = start
        removed += max(0, stop - end)
        end = max(end, stop)
    kept.append(data[end:])
    return b"".join(kept), removed, spans
