"""The prefix trie of conversations, with subtree sums by the Euler-tour technique.

Each distinct sequence of first turns (role and text) is a node; conversations that start with it are its members. A node
is named by its smallest member and its depth, which is unique. On a cluster:

1. *Keys.* Turns are sorted by ranges and numbered with a running prefix hash (two sums of 64 bits over powers of the
   place). A conversation that reaches over several ranges is continued by the totals of the ranges before, so not even
   one with most of all turns is gathered anywhere.
2. *Nodes* are groups of equal prefixes: members, smallest member, words of the last turn, parent prefix.
3. *Tour.* Each node has an enter and an exit arc. Enter is followed by the enter arc of the first child or else by the
   own exit arc, exit by the enter arc of the next sibling or else by the parent's exit arc. Children are in the order of
   their smallest members; the next sibling comes from one sort by ranges.
4. *List ranking.* The arcs of a range of nodes are chained within a task, so that only the links between chains are left;
   the list of chains is ranked in the same way, until it fits one task of bounded size. A list that hardly gets shorter
   is first thinned by splicing out arcs: those with coin 1 behind one with coin 0. Prefix sums of weights (one an arc,
   leaves, savings) come with the ranks.
5. *Sums.* What lies in a subtree is the difference of the prefix sums at the exit and enter arc of its top.

Null role or text is empty. Turns are ordered by turn (null first), then role and text. Rows without an id belong to no
conversation. Repeated rows are turns of their own. Long texts are hashed and counted where they lie. An empty table has no
conversation and no node. Columns with other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starcast.llm.word_arrays import runs
from starcast.operators.skew import ROWS_PER_LOOKUP_BLOCK, heavy_from_counts, lookup_join
from starcast.session import materialize, materialize_measured, row_count

#: Arcs that one task chains.
ARCS_PER_TASK = 200_000
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
PREFIXES = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, ends boolean"
SCANNED = "part int, conv_id long, i long, q1 long, q2 long, b1 long, b2 long, words long"
OFFSETS = "conv_id long, part int, before long, o1 long, o2 long"
CHAINED = (
    "conv_id long, e long, head_conv long, head_e long, n long, leaves long, saved long, last boolean, next_conv long,"
    " next_e long"
)
SUMS = ["n", "leaves", "saved"]


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo 2**64. Exponents may be negative, since the base is odd."""
    result = np.ones(len(exponents), np.uint64)
    for sign, factor in ((1, base), (-1, pow(base, -1, 1 << 64))):
        left = np.maximum(exponents * sign, 0)
        while left.any():
            result = np.where(left & 1, result * np.uint64(factor), result)
            factor = factor * factor % (1 << 64)
            left = left >> 1
    return result


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False) for name in names]


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the turns of each conversation of a range, with the prefix sums up to (``q``) and before (``b``) each."""
    part = TaskContext.get().partitionId()
    last, count, sums = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, words = _columns(batch, "conv_id", "words")
        edges = runs(conv)
        sizes = np.diff(edges)
        i = np.arange(len(conv)) - np.repeat(edges[:-1], sizes)
        carried = int(edges[1]) if conv[0] == last else 0
        i[:carried] += count
        upto, before = [], []
        for k, base in enumerate(_BASES):
            terms = batch.column(f"t{k + 1}").to_numpy().view(np.uint64) * _power(base, i)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
            own = total[1:] - np.repeat(total[edges[:-1]], sizes)
            own[:carried] += np.uint64(sums[k])
            upto.append(own)
            before.append(own - terms)
            sums[k] = int(own[-1])
        last, count = conv[-1], int(i[-1]) + 1
        q1, q2, b1, b2 = (values.view(np.int64) for values in (*upto, *before))
        yield _batch(part=np.full(len(conv), part, np.int32), conv_id=conv, i=i, q1=q1, q2=q2, b1=b1, b2=b2, words=words)


def _offsets(parts: pa.Table) -> pa.Table:
    """For a conversation in several ranges, what the ranges before each hold. A row for each range at most."""
    parts = parts.sort_by("part")
    before, sums, found = 0, [0, 0], []
    for row in parts.to_pylist():
        found.append((before, *(s - (1 << 64) if s >> 63 else s for s in sums)))
        for k, base in enumerate(_BASES):
            sums[k] = (sums[k] + pow(base, before, 1 << 64) * row[f"q{k + 1}"]) % (1 << 64)
        before += row["count"]
    columns = [pa.array(column, pa.int64()) for column in zip(*found)]
    return pa.table([parts["conv_id"], parts["part"], *columns], names=["conv_id", "part", "before", "o1", "o2"])


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their number and prefix sums within the range, and the offsets of conversations in several ranges."""
    order = ["conv_id", "turn", "role", "text"]
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = materialize(ranges.select("conv_id", "t1", "t2", "words").mapInArrow(_scan, SCANNED), "turns")
    # Only the first conversation of a range can have begun before it.
    firsts = scanned.groupBy("part").agg(F.min("conv_id").alias("conv_id")).select("conv_id").distinct()
    totals = scanned.join(firsts, "conv_id", "left_semi").groupBy("conv_id", "part").agg(
        F.max(F.struct("i", "q1", "q2")).alias("end")
    )
    totals = totals.select("conv_id", "part", (F.col("end.i") + 1).alias("count"), "end.q1", "end.q2")
    return scanned, totals.groupBy("conv_id").applyInArrow(_offsets, OFFSETS).where("before > 0")


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and prefix sums of whole conversations, from those of ranges and the offsets."""
    for batch in batches:
        conv, i, before, words = _columns(batch, "conv_id", "i", "before", "words")
        result = {}
        for k, base in enumerate(_BASES, 1):
            scale = _power(base, before)
            offset = batch.column(f"o{k}").to_numpy().view(np.uint64)
            for name in (f"q{k}", f"b{k}"):
                result[name] = (offset + scale * batch.column(name).to_numpy().view(np.uint64)).view(np.int64)
        yield _batch(conv_id=conv, i=i + before, **{name: result[name] for name in ("q1", "q2", "b1", "b2")}, words=words)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the own turns of rebuilt conversations: prefix sums behind ``h`` turns, put behind ``kept`` others."""
    for batch in batches:
        conv, i, h, kept, total, words = _columns(batch, "conv_id", "i", "h", "kept", "total", "words")
        keys = {}
        for k, base in enumerate(_BASES, 1):
            scale = _power(base, kept - h)
            start, lead = (batch.column(f"{name}{k}").to_numpy().view(np.uint64) for name in ("s", "g"))
            for name, column in ((f"k{k}", f"q{k}"), (f"p{k}", f"b{k}")):
                own = batch.column(column).to_numpy().view(np.uint64)
                keys[name] = (lead + (own - start) * scale).view(np.int64)
        depth = kept + i - h + 1
        yield _batch(
            conv_id=conv, depth=depth, **{n: keys[n] for n in ("k1", "k2", "p1", "p2")}, words=words, ends=depth == total
        )


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, number ``i`` from 0, prefix sums ``q`` and ``b``, and ``words`` of each turn."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("turn"), text, role).alias("t2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    scanned, offsets = numbered(turns)
    zero = {name: F.coalesce(name, F.lit(0).cast("long")) for name in ("before", "o1", "o2")}
    joined = scanned.join(offsets, ["conv_id", "part"], "left").withColumns(zero).drop("part")
    return materialize(joined.mapInArrow(_continued, SCANNED.replace("part int, ", "")), "own")


def rebuilt_prefixes(own: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """The prefixes of all conversations, each rebuilt from the first ``shared`` (at most ``most``) turns of the one that
    ``base`` names, and its own turns behind as many."""
    turn = F.struct("i", "q1", "q2", "words")
    heads = own.groupBy("conv_id").agg(
        (F.max("i") + 1).alias("count"), F.array_sort(F.collect_list(F.when(F.col("i") < most, turn))).alias("head")
    )
    heads = materialize(heads.withColumns({"h": shared.cast("long"), "base": base}), "heads")
    lead = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("lead"))
    no_turns = F.array().cast("array<struct<i:long,q1:long,q2:long,words:long>>")
    rebuilt = heads.join(lead, "base", "left").withColumn("lead", F.slice(F.coalesce("lead", no_turns), F.lit(1), F.col("h")))
    kept = F.size("lead").cast("long")
    rebuilt = rebuilt.withColumns({"kept": kept, "total": kept + F.greatest(F.col("count") - F.col("h"), F.lit(0))})

    def at(array: str, place: str, k: int) -> Column:
        return F.coalesce(F.expr(f"get({array}, cast({place} as int) - 1).q{k}"), F.lit(0).cast("long"))

    zero = F.lit(0).cast("long")
    roots = rebuilt.select(
        "conv_id", zero.alias("depth"), *[zero.alias(n) for n in ("k1", "k2", "p1", "p2", "words")],
        (F.col("total") == 0).alias("ends"),
    )
    first = rebuilt.select("conv_id", "lead", "total", F.inline("lead")).select(
        "conv_id", (F.col("i") + 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2"),
        at("lead", "i", 1).alias("p1"), at("lead", "i", 2).alias("p2"), "words", (F.col("total") == F.col("i") + 1).alias("ends"),
    )
    needed = rebuilt.select(
        "conv_id", "h", "kept", "total",
        *[at("head", "h", k).alias(f"s{k}") for k in (1, 2)], *[at("lead", "kept", k).alias(f"g{k}") for k in (1, 2)],
    )
    behind = own.join(needed, "conv_id").where("i >= h").mapInArrow(_moved, PREFIXES)
    return materialize(roots.unionByName(first).unionByName(behind), "prefixes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, read in order; the state of one node is kept, not its ids."""
    node, digest = None, None
    for batch in batches:
        found = []
        conv, *keys = _columns(batch, "conv_id", "depth", "k1", "k2")
        new = np.append(True, np.any([key[1:] != key[:-1] for key in keys], axis=0)) if len(conv) else []
        edges = np.append(np.flatnonzero(new), len(conv))
        for a, b in zip(edges[:-1], edges[1:]):
            own = tuple(int(key[a]) for key in keys)
            ids = ",".join(map(str, conv[a:b].tolist()))
            if own == node:
                digest.update(f",{ids}".encode())
                continue
            if node is not None:
                found.append((*node, digest.hexdigest()))
            node, digest = own, hashlib.sha256(ids.encode())
        yield _digest_rows(found)
    if node is not None:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, names=["depth", "k1", "k2", "ends_sha256"])


def ends_digests(prefixes: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which conversations end. The hash of a list cannot be taken in parts, so the ids of
    a node pass through one task, in order and without being held."""
    key = ["depth", "k1", "k2"]
    ends = prefixes.where("ends").select(*key, "conv_id")
    ordered = ends.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return ordered.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _next_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one's ``conv_id`` if it has the same parent. The last row of a range waits for the next."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        conv, depth, parent = (table[name].to_numpy() for name in ("conv_id", "depth", "parent_conv_id"))
        same = (depth[1:] == depth[:-1]) & (parent[1:] == parent[:-1])
        yield _sibling_rows(part, conv[:-1], depth[:-1], parent[:-1], np.where(same, conv[1:], -1), same, False)
        held = table.slice(table.num_rows - 1).to_batches()[0]
    if held is not None:
        yield _sibling_rows(part, *(held[name].to_numpy() for name in held.schema.names), np.zeros(1, np.int64), np.zeros(1, bool), True)


def _sibling_rows(part, conv, depth, parent, following, known, last) -> pa.RecordBatch:
    n = len(conv)
    columns = [pa.array(np.full(n, part, np.int32)), *map(pa.array, (conv, depth, parent))]
    columns += [pa.array(following, pa.int64(), mask=~known), pa.array(np.full(n, last))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "conv_id", "depth", "parent_conv_id", "next_sibling", "last"])


def next_siblings(tree: DataFrame) -> DataFrame:
    """``conv_id``, ``depth`` and ``next_sibling``, null for the last child."""
    order = ["parent_conv_id", "depth", "conv_id"]
    ranges = tree.where("depth > 0").select("conv_id", "depth", "parent_conv_id")
    ranges = ranges.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part int, conv_id long, depth long, parent_conv_id long, next_sibling long, last boolean"
    found = materialize(ranges.mapInArrow(_next_in_range, schema), "siblings")
    # A row for each range: the first child of the range behind.
    firsts = found.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    behind = firsts.withColumn("first", F.lead("first").over(Window.orderBy("part")))
    same = (F.col("first.parent_conv_id") == F.col("parent_conv_id")) & (F.col("first.depth") == F.col("depth"))
    lasts = found.where("last").join(behind, "part").withColumn("next_sibling", F.when(same, F.col("first.conv_id")))
    columns = ["conv_id", "depth", "next_sibling"]
    return found.where("NOT last").select(*columns).unionByName(lasts.select(*columns))


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, its key, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``first_child`` and ``saved``, the words that its members but one repeat in its last turn."""
    key = ["depth", "k1", "k2"]
    nodes = prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        row_count().alias("n_convs"),
        F.min(F.struct("p1", "p2", "words")).alias("turn"),
    )
    nodes = materialize(
        nodes.select(*key, "conv_id", "n_convs", "turn.p1", "turn.p2", ((F.col("n_convs") - 1) * F.col("turn.words")).alias("saved")),
        "nodes",
    )
    up = ["up_depth", "p1", "p2"]
    below = nodes.withColumn("up_depth", F.col("depth") - 1)
    children = below.where("depth > 0").groupBy(*up).agg(
        row_count().alias("n_children"), F.min("conv_id").alias("first_child")
    )
    children = materialize(children, "children")
    heavy = heavy_from_counts(children, up, "n_children", ROWS_PER_LOOKUP_BLOCK)
    parents = nodes.select(
        F.col("depth").alias("up_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent")
    )
    # The root's key of zeros is also its parent's, one level up, where no node is.
    named = lookup_join(below, parents, up, "left", heavy).withColumnRenamed("parent", "parent_conv_id")
    joined = named.drop(*up).join(children.toDF(*key, "n_children", "first_child"), key, "left")
    return materialize(joined.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "tree")


def arcs_of(tree: DataFrame) -> DataFrame:
    """Enter (``e`` = 2 x depth) and exit (``e`` = 2 x depth + 1) arcs of all nodes, what follows each, and its weights."""
    linked = tree.join(next_siblings(tree), ["conv_id", "depth"], "left")
    leaf = F.col("n_children") == 0
    enter = F.struct(
        "conv_id", (2 * F.col("depth")).alias("e"), F.coalesce("first_child", "conv_id").alias("next_conv"),
        F.when(leaf, 2 * F.col("depth") + 1).otherwise(2 * F.col("depth") + 2).alias("next_e"),
        leaf.cast("long").alias("leaves"), "saved",
    )
    sibling, zero = F.col("next_sibling").isNotNull(), F.lit(0).cast("long")
    leave = F.struct(
        "conv_id", (2 * F.col("depth") + 1).alias("e"), F.coalesce("next_sibling", "parent_conv_id").alias("next_conv"),
        F.when(sibling, 2 * F.col("depth")).when(F.col("depth") > 0, 2 * F.col("depth") - 1).alias("next_e"),
        zero.alias("leaves"), zero.alias("saved"),
    )
    return linked.select(F.inline(F.array(enter, leave))).withColumn("n", F.lit(1).cast("long"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains the arcs of a task: head and prefix sums of each arc, and which is the last of its chain."""
    batches = [batch for batch in batches if batch.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    order = np.lexsort((table["e"].to_numpy(), table["conv_id"].to_numpy()))
    conv, e, *sums = (table[name].to_numpy()[order] for name in ("conv_id", "e", *SUMS))
    missing = table["next_conv"].combine_chunks().is_null().to_numpy(zero_copy_only=False)[order]
    next_conv, next_e = (
        table[name].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)[order] for name in ("next_conv", "next_e")
    )
    arc = np.rec.fromarrays([conv, e], names="c,e")
    place = np.minimum(np.searchsorted(arc, np.rec.fromarrays([next_conv, next_e], names="c,e")), len(arc) - 1)
    inside = ~missing & (conv[place] == next_conv) & (e[place] == next_e)
    n = len(conv)
    before = np.full(n, -1)
    before[place[inside]] = np.flatnonzero(inside)
    # Pointer jumping towards the head; each arc adds up what lies between.
    head, sums = np.arange(n), [s.copy() for s in sums]
    jump = before.copy()
    while (going := np.flatnonzero(jump >= 0)).size:
        to = jump[going]
        sums = [_added(s, going, to) for s in sums]
        head[going] = head[to]
        jump[going] = jump[to]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (conv, e, conv[head], e[head], *sums, ~inside)]
        + [pa.array(c, mask=missing) for c in (next_conv, next_e)],
        names=[field.split()[0] for field in CHAINED.split(", ")],
    )


def _added(sums: np.ndarray, going: np.ndarray, to: np.ndarray) -> np.ndarray:
    result = sums.copy()
    result[going] += sums[to]
    return result


def _coin(salt: int) -> Callable[[str, str], Column]:
    return lambda conv, e: F.xxhash64(F.col(conv), F.col(e), F.lit(salt)).bitwiseAND(F.lit(1)) == 1


def _spliced(arcs: DataFrame, salt: int) -> DataFrame:
    """Prefix sums of a list from those of the list without the arcs with coin 1 that follow one with coin 0."""
    coin = _coin(salt)
    tails = arcs.where(~coin("conv_id", "e") & F.col("next_conv").isNotNull() & coin("next_conv", "next_e"))
    out = arcs.select(
        F.col("conv_id").alias("next_conv"), F.col("e").alias("next_e"), F.col("next_conv").alias("then_conv"),
        F.col("next_e").alias("then_e"), *[F.col(name).alias(f"out_{name}") for name in SUMS],
    )
    merged = materialize(tails.join(out, ["next_conv", "next_e"]), "spliced")
    touched = merged.select("conv_id", "e").unionByName(merged.select(F.col("next_conv").alias("conv_id"), F.col("next_e").alias("e")))
    kept = arcs.join(touched, ["conv_id", "e"], "left_anti").unionByName(
        merged.select(
            "conv_id", "e", F.col("then_conv").alias("next_conv"), F.col("then_e").alias("next_e"),
            *[(F.col(name) + F.col(f"out_{name}")).alias(name) for name in SUMS],
        )
    )
    ranked = _ranked(kept, salt + 1)
    joined = ranked.join(
        merged.select("conv_id", "e", "next_conv", "next_e", *[f"out_{name}" for name in SUMS]), ["conv_id", "e"], "left"
    )
    alone = F.struct("conv_id", "e", *[(F.col(n) - F.coalesce(f"out_{n}", F.lit(0))).alias(n) for n in SUMS])
    second = F.struct(F.col("next_conv").alias("conv_id"), F.col("next_e").alias("e"), *SUMS)
    both = F.when(F.col("next_conv").isNull(), F.array(alone)).otherwise(F.array(alone, second))
    return joined.select(F.inline(both))


def _dealt(arcs: DataFrame, parts: int) -> DataFrame:
    """Arcs of neighbouring nodes together, since most arcs lead to one of them."""
    return arcs.repartitionByRange(parts, "conv_id", "e")


def _ranked(arcs: DataFrame, salt: int) -> DataFrame:
    arcs, measured = materialize_measured(arcs, "arcs", rows=row_count())
    rows = measured["rows"]
    whole = rows <= ARCS_PER_TASK and salt > 0
    parts = 1 if whole else max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // ARCS_PER_TASK)
    dealt = arcs.repartition(1) if whole else _dealt(arcs, parts)
    chained = dealt.mapInArrow(_chain, CHAINED)
    if whole:
        return chained.select("conv_id", "e", *SUMS)
    chained, measured = materialize_measured(chained, "chains", rows=F.count_if("last"))
    if measured["rows"] > 0.7 * rows and rows > ARCS_PER_TASK:
        return _spliced(arcs, salt + 1)
    head = [F.col("head_conv").alias("conv_id"), F.col("head_e").alias("e")]
    chains = chained.where("last").select(*head, "next_conv", "next_e", *SUMS)
    ends = _ranked(chains, salt + 1).toDF("head_conv", "head_e", *[f"end_{name}" for name in SUMS])
    own = chained.where("last").select("head_conv", "head_e", *[F.col(name).alias(f"own_{name}") for name in SUMS])
    offsets = own.join(ends, ["head_conv", "head_e"])
    offsets = offsets.select("head_conv", "head_e", *[(F.col(f"end_{n}") - F.col(f"own_{n}")).alias(f"o_{n}") for n in SUMS])
    joined = chained.join(offsets, ["head_conv", "head_e"])
    return joined.select("conv_id", "e", *[(F.col(n) + F.col(f"o_{n}")).alias(n) for n in SUMS])


def list_ranks(arcs: DataFrame) -> DataFrame:
    """For each arc the sums of ``n`` (its place in the tour, from 1), ``leaves`` and ``saved`` up to it."""
    return _ranked(arcs, 0)


def trie(prefixes: DataFrame) -> DataFrame:
    """One row per node, with ``n_leaves`` and ``saved_tokens`` of its subtree, the places ``enter`` and ``leave`` of its
    arcs in the tour, and the digest of the conversations that end there."""
    tree = nodes_of(prefixes)
    ranks = list_ranks(arcs_of(tree)).withColumn("depth", F.shiftright("e", 1))
    enter, leave = F.col("e") % 2 == 0, F.col("e") % 2 == 1
    sums = ranks.groupBy("conv_id", "depth").agg(
        *[F.max(F.when(enter, F.col(n))).alias(f"in_{n}") for n in SUMS],
        *[F.max(F.when(leave, F.col(n))).alias(f"out_{n}") for n in SUMS],
    )
    leaf = (F.col("n_children") == 0).cast("long")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = tree.join(sums, ["conv_id", "depth"]).join(ends_digests(prefixes), ["depth", "k1", "k2"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("out_leaves") - F.col("in_leaves") + leaf).alias("n_leaves"),
        (F.col("out_saved") - F.col("in_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        F.col("in_n").alias("enter"), F.col("out_n").alias("leave"),
    )


def conversation_trie(conversations: DataFrame, shared: Column, base: Column, most: int) -> DataFrame:
    """The trie of rebuilt conversations, see :func:`rebuilt_prefixes`. ``shared`` and ``base`` are made of ``conv_id``."""
    return trie(rebuilt_prefixes(own_turns(conversations), shared, base, most))
