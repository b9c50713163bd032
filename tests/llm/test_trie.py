"""The prefix trie of conversations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from samples import frame
from starcast.llm import conversation_trie
from starcast.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected_nodes(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(found)] for conv, found in turns.items()}
    rebuilt = {}
    for conv, found in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = own.get(conv - conv % 20, [])[:h] + found[h:]
    members = collections.defaultdict(list)
    for conv in sorted(rebuilt):
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
    children = collections.Counter(path[:-1] for path in members if path)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(convs) - 1) * words
    result = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(path))
        up = members[path[:-1]][0] if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.append((convs[0], len(path), up, len(convs), children[path], leaves[path], saved[path], digest))
    return sorted(result, key=repr)


def talk(n=130, seed=4):
    """Conversations that share turns, some equal, some a prefix of another, some with one turn or a missing base."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        if conv in (40, 41, 60):
            continue
        for turn in range(rng.randrange(1, 7)):
            text = rng.choice(["yes", "no  way", "a b c", "", " x\ty\n", "maybe then"]) if turn < 3 else f"{rng.randrange(9)} z"
            rows.append((conv, turn, "user" if turn % 2 == 0 else "bot", text))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(60) for t in range(4)]
    rows += [(900, t, "user", f"long {t % 5}") for t in range(700)]
    rng.shuffle(rows)
    return rows


def odd():
    return [
        (None, 0, "user", "no conversation"),
        (20, None, "user", "first"),
        (20, 0, None, None),
        (20, 0, "bot", None),
        (20, 0, "bot", ""),
        (20, 5, None, "word " * 5000),
        (20, 5, None, "x" * 60_000),
        (21, 1, "user", "one"),
        (21, 1, "user", "one"),
        (21, 1, "user", "one"),
        (22, 1, "user", "one"),
        (43, 3, "user", "no base"),
        (-7, 3, "user", "below zero"),
    ]


def found_nodes(conversations):
    conv = F.col("conv_id")
    base = conv - F.pmod(conv, F.lit(20))
    found = conversation_trie.conversation_trie(conversations, F.crc32(conv.cast("string")) % 4, base, most=3).collect()
    order = sorted(found, key=lambda r: r.enter)
    assert [p for r in order for p in (r.enter, r.leave)] == [] or sorted(p for r in order for p in (r.enter, r.leave)) == list(
        range(1, 2 * len(order) + 1)
    )
    # A tour: what is entered after a node and left before it lies below.
    path = []
    for r in order:
        while path and path[-1].leave < r.enter:
            path.pop()
        assert len(path) == r.depth and (not path or r.leave < path[-1].leave)
        path.append(r)
    return sorted((tuple(r[c] for c in COLUMNS) for r in found), key=repr)


def test_trie(spark):
    df = frame(spark, talk(), SCHEMA).repartition(5)
    assert found_nodes(df) == expected_nodes(talk())


@pytest.mark.parametrize("splice", [False, True])
def test_trie_with_many_ranges_and_rounds(spark, monkeypatch, splice):
    monkeypatch.setattr(conversation_trie, "ARCS_PER_TASK", 40)
    if splice:  # ranges of no use: arcs are dealt so that hardly two in a row meet

        def scattered(arcs, parts):
            return arcs.repartition(400, "conv_id", "e")

        monkeypatch.setattr(conversation_trie, "_dealt", scattered)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [r for r in talk() if r[0] is not None and (r[0] < (20 if splice else 60) or not splice and r[0] >= 900)]
        assert found_nodes(frame(spark, rows, SCHEMA)) == expected_nodes(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_odd_rows(spark):
    rows = odd()
    assert found_nodes(frame(spark, rows, SCHEMA)) == expected_nodes(rows)
    more = frame(spark, rows, SCHEMA).withColumns({n: F.lit(1) for n in ("depth", "words", "h", "i", "part", "e", "base")})
    assert found_nodes(more) == expected_nodes(rows)


def test_trie_of_nothing(spark):
    assert found_nodes(frame(spark, [], SCHEMA)) == []


def test_query_over_its_table(spark):
    found = op11_conversation_trie(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr) == expected_nodes(rows)
