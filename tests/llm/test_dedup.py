"""Line, near-duplicate and repeated-byte removal against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from samples import awkward, documents
from starcast.llm import line_dedup, near_dedup, repeated_bytes


def unique_documents(rows):
    """Rows that repeat id and text are one document; missing ids come first."""
    return sorted({(row[0], row[1] or "") for row in rows}, key=lambda d: (d[0] is not None, d[0] or 0))


def runs(text, min_words):
    """All runs of lines with enough words: first line, last line, content."""
    lines = [(i, line.strip()) for i, line in enumerate(text.split("\n")) if line.strip()]
    for start in range(len(lines)):
        words = 0
        for end in range(start, len(lines)):
            words += len(lines[end][1].split())
            if words >= min_words:
                yield lines[start][0], lines[end][0], tuple(line for _, line in lines[start : end + 1])


def expected_lines(rows, min_words):
    """Places are compared by document first, so only texts under different ids are checked here."""
    first, gone = {}, collections.defaultdict(set)
    for doc_id, text in unique_documents(rows):
        for start, end, content in runs(text, min_words):
            if content in first:
                gone[doc_id].update(range(start, end + 1))
            else:
                first[content] = doc_id
    return {
        doc_id: "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone[doc_id])
        for doc_id, text in unique_documents(rows)
    }


def test_a_match_is_extended_both_ways(spark):
    long, short, other = (" ".join(f"{name}{i}" for i in range(n)) for name, n in (("l", 30), ("s", 5), ("o", 4)))
    rows = [(1, f"{long}\n{short}"), (2, f"{long}\n\n {short}\n{other}"), (3, f"{other}\n{long}\n{short}"), (4, short)]
    found = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 20)
    assert {r.doc_id: r.llm_kept_text.strip() for r in found.collect()} == {1: rows[0][1], 2: other, 3: other, 4: short}


@pytest.mark.parametrize("min_words", [1, 8, 20])
def test_repeated_lines(docs, min_words):
    found = line_dedup.without_repeated_lines(docs, min_words).collect()
    assert {r.doc_id: r.llm_kept_text for r in found} == expected_lines(documents(), min_words)
    assert len(found) == docs.count()


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_repeated_lines_of_odd_rows(request, name):
    df = request.getfixturevalue(name)
    found = line_dedup.without_repeated_lines(df, 20)
    assert set(df.columns) < set(found.columns)
    rows = found.collect()
    assert len(rows) == len(awkward())
    kept = collections.defaultdict(list)
    for r in rows:
        kept[r.doc_id].append((r.text, r.llm_kept_text))
    copied = awkward()[0][1]
    assert kept[None] == [(copied, copied), (None, None)] or kept[None] == [(None, None), (copied, copied)]
    assert sorted(kept[1]) == [("another text under the same id", "another text under the same id")] + [(copied, "")] * 2
    assert kept[2] == [(copied, "")] and kept[3] == [(None, None)] and kept[4] == [("", "")]


def shingle_set(text, k):
    words = near_dedup.words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def expected_components(rows, k, percent):
    sets = collections.defaultdict(set)
    for doc_id, text in unique_documents(rows):
        if doc_id is not None:
            sets[doc_id].add(shingle_set(text, k))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates(docs, k, percent):
    rows = near_dedup.near_duplicates(docs, k, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected_components(documents(), k, percent)
    texts = {row[0]: row[1] for row in documents()}
    assert all(r.n_shingles == len(shingle_set(texts[r.doc_id], k)) for r in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(not r.kept for r in rows) > 5


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_near_duplicates_of_odd_rows(request, name):
    rows = near_dedup.near_duplicates(request.getfixturevalue(name)).collect()
    assert len(rows) == len(awkward())
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == expected_components(awkward(), 4, 80)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)


def test_each_text_of_an_id_has_its_links(spark):
    words = [f"a{i}" for i in range(60)]
    rows = [(5, " ".join(words)), (5, " ".join(f"b{i}" for i in range(500))), (9, " ".join(words[:58])), (7, "c " * 9)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(5, 5), (5, 5), (7, 7), (9, 5)]


def chained_copies(n):
    """Each text is close to the next one, and far from those that are further away."""
    words = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [*words[:i * 5], f"b{i}", *words[i * 5 + 1:]]
        rows.append((i, " ".join(words), None, None, None))
    return rows


def test_chains_of_links_are_followed(spark):
    rows = chained_copies(30)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert found == expected_components(rows, 4, 80)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.component for r in near_dedup.components(df).collect()} == {x: root(x) for x in parent}


def test_signatures_estimate_similarity_and_ignore_block_borders(monkeypatch):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = near_dedup.super_minhash(a, 512), near_dedup.super_minhash(b, 512)
    assert abs(np.mean(x == y) - 300 / 500) < 0.08
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    assert (near_dedup.super_minhash(a, 512) == x).all()


def expected_bytes(rows):
    texts = [(row[0], (row[1] or "").encode()) for row in rows]
    n = repeated_bytes.LENGTH
    counts = collections.Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    result = []
    for doc_id, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - n + 1):
            if counts[t[p : p + n]] > 1:
                gone[p : p + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int(np.sum(np.diff(np.concatenate([[0], gone[:-1].astype(int)])) == 1))
        result.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=repr)


def found_bytes(df):
    found = repeated_bytes.without_repeats(df).drop("kept").collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_repeated_bytes(docs):
    expected = expected_bytes(documents())
    assert found_bytes(docs) == expected
    assert any(0 < removed < size for _, size, removed, *_ in expected)


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_repeated_bytes_of_odd_rows(request, name):
    assert found_bytes(request.getfixturevalue(name)) == expected_bytes(awkward())


def test_repeated_bytes_across_pieces(spark, docs, monkeypatch):
    shifted = [(100 + i, "zz" + (text or "")[i:], *rest) for i, (_, text, *rest) in enumerate(documents()[:12])]
    rows = documents()[:30] + shifted
    df = spark.createDataFrame(rows, docs.schema)
    assert found_bytes(df) == expected_bytes(rows)


@pytest.mark.parametrize("piece", [256, 1000])
def test_anchors_do_not_depend_on_pieces(monkeypatch, piece):
    text = documents()[5][1].encode() * 3

    def strings():
        owners = {}
        for name, _, place in repeated_bytes._anchor_rows(text):
            for n, p in zip(name.tolist(), place.tolist()):
                for start in range(p >> 16, (p >> 16) + ((p >> 8) & 255) + 1):
                    owners[start] = n, (p >> 16) + (p & 255)
        return owners

    whole = strings()
    monkeypatch.setattr(repeated_bytes, "PIECE", piece)
    assert strings() == whole and sorted(whole) == list(range(len(text) - repeated_bytes.LENGTH + 1))


def test_empty_tables(none):
    assert line_dedup.without_repeated_lines(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert repeated_bytes.without_repeats(none).count() == 0


def test_no_task_of_near_dedup_runs_two_steps_in_python(spark, monkeypatch):
    plans, contract = [], near_dedup.contract

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return contract(edges)

    monkeypatch.setattr(near_dedup, "contract", seen)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (3, base + " y"), (4, "something else entirely here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(plans) == 2 and not any("Pandas" in plan or "Arrow" in plan for plan in plans)
