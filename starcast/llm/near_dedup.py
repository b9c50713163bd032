"""Groups near-duplicate documents: SuperMinHash signatures, banding, verification on whole sets, union-find.

1. One pass over the texts gives each document its shingle set's size, its SuperMinHash signature cut into bands, and
   a hash of its words. Documents with the same words are one class, numbered by that hash.
2. Classes that agree in a band are candidates. Each is linked to the smallest one of its band's bucket, so
   buckets become clusters without a pair being listed.
3. The whole sets of a cluster's members, of 64-bit shingle hashes, are compared in cells: small clusters share one, and
   a large one is cut into blocks of about ``CELL`` members, with a cell for each two blocks. A cell counts what its
   sets have in common shingle by shingle, and returns a link from each member to the smallest one it reaches.
4. Links are contracted by union-find within each task, and the remaining forests by large and small stars over
   shuffles until nothing changes.

So all pairs in a cluster are verified, but a member makes no more rows than its cluster has blocks, and a cell has a
bounded number of members.

A signature has ``BANDS * ROWS`` values. A pair at the least similarity of 0.8 shares no band with a probability of
(1 - 0.8^4)^24 = 3e-6, and a more similar pair with less.

Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than ``k`` words is one shingle; a text
without words, or null, has none and is linked with nothing. Rows that repeat id and text are one document. If an id
occurs with several texts, they are one document as to components. Rows without id form no class, are linked with
nothing and have a null component. Long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from starcast.llm.common import texts
from starcast.session import materialize

BANDS, ROWS = 24, 4
BLOCK = 16_384
#: Members of a block of a cluster; a cell holds two blocks.
CELL = 512
FEW = 16
SIGNATURES = "doc_id long, text_key long, n_shingles long, words_a long, words_b long, bands array<long>"

_GOLDEN, _MIX1, _MIX2 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each value (the finaliser of splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``k`` words; of all words together if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    own = hashes(words)
    size = min(k, len(own))
    mixed = np.full(len(own) - size + 1, size, np.uint64)
    for j in range(size):
        mixed = _mixed(mixed ^ own[j : len(own) - size + 1 + j])
    return np.unique(mixed)


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of hashes.

    Each element deals the ranks 0 to m-1 to the m places by a permutation of its own, built step by step, and offers
    rank plus a uniform fraction to each place. The least offer stays. Once every place holds less than the rank to
    come, no later step can change anything; larger sets stop after a few steps.
    """
    signature = np.full(m, np.inf)
    for start in range(0, len(elements), BLOCK):
        block = elements[start : start + BLOCK]
        places = np.tile(np.arange(m, dtype=np.int16), (len(block), 1))
        rows = np.arange(len(block))
        for rank in range(m):
            if signature.max() < rank:
                break
            draw = _mixed(block ^ np.uint64((rank + 1) << 32))
            fraction = (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
            other = rank + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - rank)).astype(np.int64)
            chosen = places[rows, other]
            places[rows, other] = places[:, rank]
            places[:, rank] = chosen
            np.minimum.at(signature, chosen, rank + fraction)
    return signature


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One hash per band of the signature."""
    values = signature.view(np.uint64).reshape(BANDS, ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        mixed = _mixed(mixed ^ values[:, row])
    return mixed.view(np.int64)


def words_of(text: str) -> list[bytes]:
    # bytes.split() splits at ASCII white space only, and bytes.lower() changes A-Z only.
    return text.encode("utf-8", "surrogatepass").lower().split()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                words = words_of(text)
                if not words:
                    rows.append((doc_id, key, 0, 0, 0, None))
                    continue
                own = shingles(words, k, hashes)
                digest = np.frombuffer(xxh3_128_digest(b" ".join(words)), np.int64)
                rows.append((doc_id, key, len(own), *digest.tolist(), bands_of(super_minhash(own, BANDS * ROWS))))
            names = [field.split()[0] for field in SIGNATURES.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(run, SIGNATURES)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``rep`` and ``shingles``, the whole set, of rows of ``doc_id`` and ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(words_of(text), k, hashes).view(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"rep": batch["doc_id"], "shingles": sets})

    return docs.mapInPandas(run, "rep long, shingles array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common."""
    n = len(sets)
    element = np.concatenate(sets) if sets else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(own) for own in sets])
    order = np.lexsort((owner, element))
    element, owner = element[order], owner[order]
    first = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(element)))
    held = np.repeat(size, size)
    counts = np.zeros((n, n))
    # Elements of few sets: each with those that follow it. Elements of many sets: products of columns.
    few = (held > 1) & (held <= FEW)
    rare, rare_owner = element[few], owner[few]
    for step in range(1, FEW):
        same = rare[step:] == rare[:-step]
        counts += np.bincount(rare_owner[:-step][same] * n + rare_owner[step:][same], minlength=n * n).reshape(n, n)
    counts += counts.T
    many = held > FEW
    column = np.cumsum(np.append(True, np.diff(element[many]) != 0)) - 1 if many.any() else np.empty(0, np.int64)
    for start in range(0, int(column.max(initial=-1)) + 1, 4096):
        own = (column >= start) & (column < start + 4096)
        table = np.zeros((n, 4096), np.float32)
        table[owner[many][own], column[own] - start] = 1
        counts += table @ table.T
    return counts


def links_of(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A link from each member of a cell to the smallest one that it reaches over similar pairs."""
    cell = cell.sort_values("rep", ignore_index=True)
    sets = [np.asarray(own, np.int64) for own in cell["shingles"]]
    common = common_counts(sets)
    size = np.array([len(own) for own in sets], np.float64)
    union = size[:, None] + size[None, :] - common
    near = 100 * common >= percent * union
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        new = np.where(near, label[None, :], len(sets)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    found = label != np.arange(len(sets))
    rep = cell["rep"].to_numpy()
    return pd.DataFrame({"a": rep[found], "b": rep[label[found]]})


def link(sets: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that connect what similar pairs connect. ``sets``: ``rep``, ``shingles``; ``clusters``:
    ``rep``, ``cluster`` and ``n``, the number of its members."""
    total = max(1, clusters.count())
    blocks = F.ceil(F.col("n") / CELL).cast("int")
    dealt = clusters.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep",
        # Clusters of one block share cells.
        F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(
            F.pmod(F.xxhash64("cluster"), F.lit(-(-total // CELL)))
        ).alias("of"),
        F.least("own", "other").alias("low"),
        F.when(F.col("blocks") > 1, F.greatest("own", "other")).otherwise(-1).alias("high"),
    )
    cells = sets.join(dealt, "rep").groupBy("of", "low", "high")
    return cells.applyInPandas(lambda cell: links_of(cell, percent), "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """The links ``a``, ``b`` of each task as stars around the smallest member, by union-find."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        stars = [(x, root(x)) for x in parent]
        yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["a", "b"], dtype="int64")

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable over the links ``a``, ``b``; only nodes with links.

    Rounds of large stars (each larger neighbour moves to the smallest one) and small stars (each smaller neighbour
    does) end in stars around the smallest member. A node's neighbours are never gathered: their minimum is
    aggregated and joined back.
    """
    stars, before = materialize(contract(edges).distinct(), "stars"), None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        ordered = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = ordered.groupBy("a").agg(F.min("b").alias("m"))
        small = ordered.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        stars = materialize(small.where("a <> b").distinct(), "stars")
        state = tuple(stars.agg(F.count("a"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``text_key``, ``n_shingles``, ``component_id`` and ``kept``."""
    signed = materialize(signatures(docs, k), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same_words = filled.groupBy("words_a", "words_b").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("bands").alias("bands")
    )
    # A class is numbered by its words, since an id may have several texts.
    classes = materialize(
        same_words.select(
            "words_a", "words_b", F.xxhash64("words_a", "words_b").alias("rep"), "first.doc_id", "first.text_key", "bands"
        ),
        "classes",
    )
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(banded.join(full, "bucket").select("bucket", "rep"), "buckets")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(_sets_of(named, members, classes, k), "sets")

    least = members.groupBy("bucket").agg(F.min("rep").alias("b"))
    stars = members.join(least, "bucket").select(F.col("rep").alias("a"), "b").where("a <> b").distinct()
    clusters = materialize(components(stars).toDF("rep", "cluster"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    similar = link(sets, clusters.join(sizes, "cluster"), percent)
    # Texts that share an id are one document.
    ids = filled.join(classes.select("words_a", "words_b", "rep"), ["words_a", "words_b"]).select("doc_id", "rep")
    lowest = ids.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = ids.join(lowest, "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    # Written between two steps in Python: a task that runs both holds two workers, which then stay.
    grouped = components(materialize(similar.unionByName(shared), "links"))
    located = classes.join(grouped, F.col("rep") == F.col("node"), "left").select(
        "words_a", "words_b", "doc_id", F.coalesce("component", "rep").alias("component")
    )
    smallest = located.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    located = located.join(smallest, "component").select("words_a", "words_b", "component_id")
    rows = signed.join(
        located.withColumn("known", F.lit(True)),
        (signed["words_a"] == located["words_a"]) & (signed["words_b"] == located["words_b"])
        & signed["doc_id"].isNotNull() & (signed["n_shingles"] > 0),
        "left",
    )
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return rows.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _sets_of(named: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The shingle sets of the classes that share a bucket with others."""
    needed = classes.join(members.select("rep").distinct(), "rep", "left_semi")
    needed = needed.select("rep", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    keyed = named.where("text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    chosen = keyed.join(needed, (F.col("doc_id") == F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    # Rows that repeat id and text give the same set.
    sets = shingle_sets(chosen.select(F.col("rep").alias("doc_id"), "text"), k)
    return sets.groupBy("rep").agg(F.any_value("shingles").alias("shingles"))
