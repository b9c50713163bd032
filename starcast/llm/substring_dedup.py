"""Removes words that lie in a passage of an earlier document, by fixed-block anchors.

A *window* is ``window`` consecutive words of one document. It goes if its words also start in a document with a smaller
id. Each window holds a whole *block* of ``block`` words at a multiple of ``block`` in any document that has it, since
``window >= 2 * block - 1``:

1. *Index.* The non-overlapping blocks of all documents, with the smallest id that has each.
2. *Probe.* Every rolling run of ``block`` words of every document is looked up. It is a hit if an earlier document has
   it as a block. The first owner of a block that was hit takes part too, since it holds what the hit is compared with.
3. *Extend.* Around each hit lie the windows that hold it, up to ``window - block`` words on either side. Their hashes
   are matched again, whole, against the smallest id that has them; windows that match merge into maximal repeats.

Both matches are joins by bucket of hash. Hashes of many documents travel packed in one binary value for each bucket and
task, four bytes a rolling run in step 2 (a chance match there costs work, not a wrong result) and eight bytes, next to
the bucket, in step 3. A side holds one entry for a hash and slice of input, however many documents repeat it. Buckets
with many probes are cut into cells, each with its own copy of the index part. Nothing is compared in pairs.

Null and empty texts have no words. A text shorter than a window loses nothing. Rows without an id lose nothing and count
as earlier than none. Rows that share an id are not earlier than each other; each is judged on its own text. Copies of a
row get the same result. Windows are judged on the input. Long texts are handled whole, with eight bytes a word. An empty
table gives an empty result. Columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.llm.word_arrays import (
    WHITE_SPACE,
    binary_array,
    buckets_of,
    hash_words,
    numbers,
    run_hashes,
    runs,
    slices,
)
from starcast.operators.skew import heavy_from_counts
from starcast.session import materialize, materialize_measured

WINDOW, BLOCK = 50, 25
#: Bytes of text for each bucket of the first match, and windows for each bucket of the second.
TEXT_PER_BUCKET, WINDOWS_PER_BUCKET = 40 << 20, 1 << 20
#: Fewer buckets would leave executors idle, and make the rows of hits grow with the number of buckets.
LEAST_BUCKETS = 32
#: Bytes of probes that one task takes of a bucket.
PROBES_PER_CELL = 64 << 20
INDEX = "bucket int, keys binary, lows binary, load long"
PROBES = "bucket int, ids binary, counts binary, keys binary"
HITS = "doc_id long, keys binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept_text string"

#: Row of each key, ids of the rows, all keys, and which of them are indexed.
Keyed = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _blocks(length: int) -> Callable[[pa.RecordBatch], Keyed]:
    """The rolling runs of ``length`` words of a batch; those at multiples of ``length`` are indexed."""

    def keyed(batch: pa.RecordBatch) -> Keyed:
        ids = batch.column("doc_id").to_numpy()
        for first, end, data, bounds in slices(batch.column("text")):
            words, _, row = hash_words(data, bounds)
            keys = run_hashes(words, length)
            whole = np.flatnonzero(row[: len(keys)] == row[length - 1 :]) if len(keys) else np.empty(0, np.int64)
            row = row[whole]
            edges = runs(row)
            place = np.arange(len(row)) - np.repeat(edges[:-1], np.diff(edges))
            yield row, ids[first:end], keys[whole], place % length == 0

    return keyed


def _windows(batch: pa.RecordBatch) -> Keyed:
    """The windows of a batch of documents, all of them indexed."""
    ids, held = batch.column("doc_id").to_numpy(), numbers(batch.column("keys"), np.uint64)
    first = size = 0
    for end, keys in enumerate(held, 1):
        size += len(keys)
        if size >= 1 << 20 or end == len(held):
            row = np.repeat(np.arange(end - first), [len(k) for k in held[first:end]])
            yield row, ids[first:end], np.concatenate(held[first:end]), np.ones(size, bool)
            first, size = end, 0


def _shorten(keys: np.ndarray, n_buckets: int, kind: type) -> np.ndarray:
    """What travels of a key beside its bucket, and comes back with it."""
    if kind is np.uint64:
        return keys
    return (buckets_of(keys, n_buckets).astype(np.uint64) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _index(keyed: Callable, n_buckets: int, kind: type):
    """For each bucket the indexed keys with the smallest id that has them, and the bytes of the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, keys, indexed in keyed(batch):
                bucket = buckets_of(keys, n_buckets)
                load = np.bincount(bucket, minlength=1) * np.dtype(kind).itemsize
                own, low, where = keys[indexed].astype(kind), ids[row[indexed]], bucket[indexed]
                order = np.lexsort((low, own, where))
                own, low, where = own[order], low[order], where[order]
                if len(own):
                    new = np.append(True, (own[1:] != own[:-1]) | (where[1:] != where[:-1]))
                    own, low, where = own[new], low[new], where[new]
                some = np.flatnonzero(load)
                edges = np.append(np.searchsorted(where, some), len(where))
                columns = [some.astype(np.int32), binary_array(own, edges), binary_array(low, edges), load[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "keys", "lows", "load"])

    return run


def _probe(keyed: Callable, n_buckets: int, kind: type):
    """For each bucket the keys of a slice, and whose they are: ids, and how many keys each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, keys, _ in keyed(batch):
                bucket = buckets_of(keys, n_buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, row, keys = bucket[order], row[order], keys[order].astype(kind)
                edges = runs(bucket)
                new = runs(bucket.astype(np.int64) * (len(ids) + 1) + row)
                of_bucket = np.searchsorted(new, edges)
                columns = [
                    bucket[edges[:-1]].astype(np.int32),
                    binary_array(ids[row[new[:-1]]], of_bucket),
                    binary_array(np.diff(new).astype(np.int32), of_bucket),
                    binary_array(keys, edges),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "ids", "counts", "keys"])

    return run


def _match(kind: type, owners: bool):
    """The probes of a cell that the index knows from an earlier document; with ``owners``, also the first owners of what
    was hit."""

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, kind), *numbers(index["keys"], kind)])
        lows = np.concatenate([np.empty(0, np.int64), *numbers(index["lows"], np.int64)])
        order = np.lexsort((lows, keys))
        keys, lows = keys[order], lows[order]
        new = runs(keys)[:-1] if len(keys) else np.empty(0, np.int64)
        keys, lows = keys[new], lows[new]
        hit_owner = np.zeros(len(keys), bool)
        found_ids, found_keys = [], []
        columns = [numbers(probes[name], t) for name, t in (("ids", np.int64), ("counts", np.int32), ("keys", kind))]
        for ids, counts, own in zip(*columns) if len(keys) else ():
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            id_ = np.repeat(ids, counts)
            hit = (keys[place] == own) & (lows[place] < id_)
            hit_owner[place[hit]] = True
            found_ids.append(id_[hit])
            found_keys.append(own[hit])
        found_ids.append(lows[hit_owner & owners])
        found_keys.append(keys[hit_owner & owners])
        id_, own = np.concatenate(found_ids), np.concatenate(found_keys)
        order = np.lexsort((own, id_))
        id_, own = id_[order], own[order].astype(np.uint64)
        if kind is not np.uint64:
            bucket = probes["bucket"][0].as_py() if len(probes) else 0
            own |= np.uint64(bucket << 32)
        edges = runs(id_)
        return pa.table({"doc_id": id_[edges[:-1]], "keys": binary_array(own, edges)})

    return run


def _hits(rows: DataFrame, keyed: Callable, n_buckets: int, kind: type, owners: bool, label: str) -> DataFrame:
    """``doc_id`` and ``keys``: of each document the keys that an earlier one has in the index. A document has one row
    for each bucket and cell."""
    index = materialize(rows.mapInArrow(_index(keyed, n_buckets, kind), INDEX), f"{label}-index")
    loads = index.groupBy("bucket").agg(F.sum("load").alias("load"))
    heavy = heavy_from_counts(loads, ["bucket"], "load", PROBES_PER_CELL)
    probes = rows.mapInArrow(_probe(keyed, n_buckets, kind), PROBES)
    index, cell = index.drop("load"), F.lit(0)
    if heavy.table is not None:
        index = heavy.attach(index, "cells").withColumn("cell", F.explode(F.expr("sequence(0, cells - 1)"))).drop("cells")
        probes, cell = heavy.attach(probes, "cells"), F.expr("cast(pmod(xxhash64(ids, keys), cells) as int)")
    else:
        index = index.withColumn("cell", F.lit(0))
    probes = probes.withColumn("cell", cell)
    sides = [side.groupBy("bucket", "cell") for side in (probes, index)]
    return materialize(sides[0].cogroup(sides[1]).applyInArrow(_match(kind, owners), HITS), f"{label}-hits")


def _with_hits(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    listed = hits.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    return docs.join(listed, "doc_id", how)


def _known(keys: np.ndarray, held: pa.Scalar) -> np.ndarray:
    """Which keys of a document are among those that were found."""
    found = np.concatenate([np.frombuffer(value.as_buffer(), np.uint64) for value in held.values])
    return np.isin(keys, found)


def _candidates(window: int, block: int, n_buckets: int):
    """Hashes of the windows of each document that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("keys")
            for first, end, data, bounds in slices(batch.column("text")):
                words, _, row = hash_words(data, bounds)
                edges = np.searchsorted(row, np.arange(end - first + 1))
                own_keys = []
                for i in range(end - first):
                    own = words[edges[i] : edges[i + 1]]
                    whole = run_hashes(own, window)
                    if not len(whole):
                        own_keys.append(whole)
                        continue
                    hit = np.flatnonzero(_known(_shorten(run_hashes(own, block), n_buckets, np.uint32), held[first + i]))
                    # The windows from ``window - block`` words before a hit up to the hit itself.
                    change = np.zeros(len(whole) + 1, np.int64)
                    np.add.at(change, np.clip(hit - (window - block), 0, len(whole)), 1)
                    np.add.at(change, np.minimum(hit + 1, len(whole)), -1)
                    own_keys.append(whole[np.cumsum(change[:-1]) > 0])
                sizes = np.cumsum([0, *[len(k) for k in own_keys]])
                yield pa.RecordBatch.from_arrays(
                    [ids[first:end], binary_array(np.concatenate(own_keys), sizes)], names=["doc_id", "keys"]
                )

    return run


def _spans(known: np.ndarray, window: int) -> list[tuple[int, int]]:
    """First word and number of words of each maximal run of words that known windows cover."""
    start = np.flatnonzero(known)
    if not len(start):
        return []
    new = np.append(True, start[1:] > start[:-1] + window)
    last = np.append(start[np.flatnonzero(new)[1:] - 1], start[-1])
    return [(int(a), int(b - a + window)) for a, b in zip(start[new], last)]


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_words", pa.int64()),
                ("n_removed", pa.int64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ("kept_text", pa.string()),
            ]
        )
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("keys")
            for first, end, data, bounds in slices(batch.column("text")):
                rows = []
                for i in range(end - first):
                    own = data[bounds[i] : bounds[i + 1]]
                    words = own.tobytes().split()
                    spans: list[tuple[int, int]] = []
                    if held[first + i].is_valid and len(words) >= window:
                        hashes = hash_words(own, np.array([0, len(own)]), WHITE_SPACE)[0]
                        spans = _spans(_known(run_hashes(hashes, window), held[first + i]), window)
                    for start, length in reversed(spans):
                        del words[start : start + length]
                    gone = sum(length for _, length in spans)
                    rows.append(
                        {
                            "doc_id": ids[first + i].as_py(),
                            "n_words": len(words) + gone,
                            "n_removed": gone,
                            "spans": [{"start": start, "length": length} for start, length in spans],
                            "kept_text": b" ".join(words).decode(),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``spans`` (of removed words) and ``kept_text`` (what stays, joined by a
    space) of every row."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = own.where("doc_id IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, 1 + size // TEXT_PER_BUCKET)
    hits = _hits(named, _blocks(block), n_buckets, np.uint32, True, "blocks")
    windows, measured = materialize_measured(
        _with_hits(named, hits, "inner").mapInArrow(_candidates(window, block, n_buckets), HITS).where("length(keys) > 0"),
        "windows",
        size=F.sum(F.length("keys")),
    )
    n_buckets = max(LEAST_BUCKETS, 1 + (measured["size"] or 0) // (8 * WINDOWS_PER_BUCKET))
    repeats = _hits(windows, _windows, n_buckets, np.uint64, False, "windows")
    return _with_repeats(own, repeats).mapInArrow(_cut(window), RESULT)


def _with_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    return _with_hits(docs, repeats, "left")
