"""Word-level operators against brute force: repeated passages, collocations."""

import collections
import random
import re

import numpy as np
import pytest
from samples import awkward, documents, frame
from starcast.llm import collocations, substring_dedup
from starcast.llm.word_arrays import WHITE_SPACE, hash_words


def words_of(text):
    return (text or "").encode().split()


def expected_repeats(rows, window):
    """``n_words``, ``n_removed`` and kept words of each row."""
    first = {}
    for row in rows:
        words = words_of(row[1])
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if row[0] is not None:
                first[key] = min(first.get(key, row[0]), row[0])
    result = []
    for row in rows:
        words, gone = words_of(row[1]), set()
        for i in range(len(words) - window + 1):
            if row[0] is not None and first[tuple(words[i : i + window])] < row[0]:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        result.append((row[0], len(words), len(gone), kept))
    return sorted(result, key=repr)


def found_repeats(df, **options):
    rows = substring_dedup.without_repeats(df, **options).collect()
    for row in rows:
        assert sum(span["length"] for span in row["spans"]) == row["n_removed"]
        assert all(a["start"] + a["length"] < b["start"] for a, b in zip(row["spans"], row["spans"][1:]))
    return sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows], key=repr)


@pytest.mark.parametrize("window,block", [(50, 25), (7, 4), (5, 2), (1, 1)])
def test_repeated_passages(docs, window, block):
    assert found_repeats(docs, window=window, block=block) == expected_repeats(documents(), window)


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_repeated_passages_of_odd_rows(request, name):
    assert found_repeats(request.getfixturevalue(name)) == expected_repeats(awkward(), 50)


def test_repeated_passages_of_nothing(none):
    assert found_repeats(none) == []


def test_a_block_in_other_surroundings_decides_by_the_whole_window(spark):
    """All documents share one block; only some share a window around it, at every shift, with hot buckets cut."""
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(9)]
    rows = []
    for i in range(120):
        before, after = ([f"{side}{rng.randrange(2)}" for _ in range(6)] for side in "ab")
        rows.append((i, " ".join(["x"] * rng.randrange(7) + before + hot + after)))
    df = frame(spark, rows, "doc_id long, text string").repartition(5)
    before = substring_dedup.PROBES_PER_CELL, substring_dedup.TEXT_PER_BUCKET
    substring_dedup.PROBES_PER_CELL, substring_dedup.TEXT_PER_BUCKET = 64, 1024
    try:
        assert found_repeats(df, window=11, block=5) == expected_repeats(rows, 11)
    finally:
        substring_dedup.PROBES_PER_CELL, substring_dedup.TEXT_PER_BUCKET = before


def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    from starcast.llm import word_arrays

    monkeypatch.setattr(word_arrays, "PIECE", 16)
    word_arrays._powers.cache_clear()
    texts = ["one two  three", "", "one", "a" * 50 + " b", "zwei\tdrei\nöäü", " one two "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    hashes, starts, rows = hash_words(data, bounds, WHITE_SPACE)
    words = [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    assert [(int(r), data[s:].tobytes()[: len(w)]) for r, s, (_, w) in zip(rows, starts, words)] == words
    by_word = collections.defaultdict(set)
    for (_, word), value in zip(words, hashes):
        by_word[word].add(int(value))
    assert len(hashes) == len(words) and all(len(v) == 1 for v in by_word.values())
    assert len({v for values in by_word.values() for v in values}) == len(by_word)
    word_arrays._powers.cache_clear()


def expected_collocations(rows, least, top):
    """``lang`` -> list of (rank, phrase, a, l, r, n, score)."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = {}
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        hidden = {
            p[i : i + k]
            for p, a in candidates.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if 100 * a >= 80 * own[p[i : i + k]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in hidden:
                cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        result[lang] = [
            (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
            for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)
        ]
    return sorted(row for rows in result.values() for row in rows)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def talk(n=300, seed=9):
    """Texts of two languages, and of none, that share words, with fixed phrases, ties, cuts and capitals."""
    rng = random.Random(seed)
    fixed = ["New York City Hall", "in spite of", "q\tr s", "Éa éB", "x, y", "tie one", "tie two"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.3 else f"{'wW'[rng.randrange(2)]}{rng.randrange(9)}" for _ in range(30)]
        text = "".join(w + rng.choice([" ", " ", "  ", ". ", "\n", "\t"]) for w in words)
        rows.append((i, text, ["en", "de", None][i % 3]))
    return rows


@pytest.mark.parametrize("least,top,small", [(30, 2000, False), (3, 25, False), (3, 40, True)])
def test_collocations(spark, monkeypatch, least, top, small):
    if small:  # several buckets, cut into cells, and a map too small to tell pairs apart
        for name, value in (("SLICE", 3000), ("TEXT_PER_BUCKET", 9000), ("SUFFIXES_PER_BUCKET", 300), ("MAP_BITS", 15)):
            monkeypatch.setattr(collocations, name, value)
    rows = talk()
    df = frame(spark, rows, "doc_id long, text string, lang string").repartition(4)
    found = collocations.collocations(df, least, top=top).select(*COLUMNS).collect()
    expected = expected_collocations(rows, least, top)
    assert sorted(map(tuple, found)) == expected and len(expected) > 3


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_collocations_of_odd_rows(request, name):
    found = collocations.collocations(request.getfixturevalue(name)).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == expected_collocations(awkward(), 30, 2000)


def test_collocations_of_nothing(none):
    assert collocations.collocations(none).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    count = 5_000_000_000_000_003
    found = frame(spark, [("en", [3, 5], count)], "lang string, words array<long>, a long")
    leading = frame(spark, [(3, count + 7), (5, count + 1)], "key long, n long")
    row = collocations.scored(found, leading, 80).first()
    assert (row.l, row.r, row.score) == (count + 7, count + 1, 2_000_000 * count // (2 * count + 8))


def test_quicksort_counts_prefixes():
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    columns = [np.array([r[d] if d < len(r) else 0 for r in rows], np.uint64) for d in range(4)]
    counts = np.array([rng.randrange(1, 4) for _ in rows])
    expected = collections.Counter()
    for row, count in zip(rows, counts):
        for k in range(1, len(row) + 1):
            expected[row[:k]] += int(count)
    found = {rows[p][:size]: count for p, size, count in collocations.quicksort(columns, counts, 20)}
    assert found == {prefix: count for prefix, count in expected.items() if count >= 20}
