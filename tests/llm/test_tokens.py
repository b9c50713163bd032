"""Token counts and packing against direct computation."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import awkward, documents
from starcast.llm import packing, token_counts
from starcast.llm.queries import RANKS
from starcast.session import shared_path
from tokenizers import Tokenizer

FILES = {"byte_bpe_50k": RANKS, "words": ""}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected_totals(rows, tokenizer):
    totals = collections.Counter()
    for _, text, lang, source, _ in rows:
        text = text or ""
        for version, n in (
            ("byte_bpe_50k", len(tokenizer.encode(text, add_special_tokens=False).ids)),
            ("words", len(text.split())),
        ):
            cell = source, lang, version
            totals[cell, "docs"] += 1
            totals[cell, "tokens"] += n
            totals[cell, "chars"] += len(text)
    return {cell: tuple(totals[cell, k] for k in ("docs", "tokens", "chars")) for cell, _ in totals}


def found_totals(df):
    return {
        (r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_chars)
        for r in df.collect()
        if r.n_docs or r.n_tokens
    }


def test_totals_follow_inserts_revisions_and_deletes(spark, docs, tokenizer):
    store = shared_path(spark, "store")
    counts = token_counts.count_tokens(docs, FILES, ("doc_id",))
    token_counts.commit(token_counts.changes(counts, tokens=counts.n_chars), store, "1")
    token_counts.commit(token_counts.revisions(counts, "n_chars", "n_tokens"), store, "2")
    assert found_totals(token_counts.totals(spark, store)) == expected_totals(documents(), tokenizer)
    gone = counts.where("doc_id % 4 = 0")
    token_counts.commit(token_counts.changes(gone, -1), store, "3")
    left = [row for row in documents() if row[0] % 4]
    assert found_totals(token_counts.totals(spark, store)) == expected_totals(left, tokenizer)
    token_counts.commit(token_counts.changes(gone, -1), store, "3")  # a retry changes nothing
    assert found_totals(token_counts.totals(spark, store)) == expected_totals(left, tokenizer)


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_counts_of_odd_rows(spark, request, tokenizer, name):
    store = shared_path(spark, "store")
    counts = token_counts.count_tokens(request.getfixturevalue(name), FILES)
    token_counts.commit(token_counts.changes(counts), store, "1")
    assert found_totals(token_counts.totals(spark, store)) == expected_totals(awkward(), tokenizer)


def test_empty_batch(spark, none):
    store = shared_path(spark, "store")
    token_counts.commit(token_counts.changes(token_counts.count_tokens(none, FILES)), store, "1")
    assert token_counts.totals(spark, store).count() == 0


def changes_of(spark, n_tokens, source="a"):
    rows = [(source, "en", "words", 1, n_tokens, 10)]
    return spark.createDataFrame(rows, token_counts.SCHEMA)


def test_a_retry_that_fails_half_way_leaves_the_batch(spark):
    store = shared_path(spark, "store")
    broken = spark.range(100).selectExpr(
        "'a' AS source", "'en' AS lang", "'words' AS tokenizer_version", "1L AS n_docs",
        "IF(id = 99, raise_error('stop'), 1L) AS n_tokens", "1L AS n_chars",
    )
    with pytest.raises(Exception, match="stop"):
        token_counts.commit(broken, store, "1")
    assert token_counts.totals(spark, store).count() == 0
    assert token_counts.commit(changes_of(spark, 5), store, "1")
    # A batch that is there stays as it is, even if a retry would fail or hold something else.
    assert not token_counts.commit(broken, store, "1")
    assert not token_counts.commit(changes_of(spark, 50), store, "1")
    assert [r.n_tokens for r in token_counts.totals(spark, store).collect()] == [5]


def test_snapshots_hold_each_batch_once(spark):
    store = shared_path(spark, "store")
    assert token_counts.fold(spark, store) == 0
    for name in ("day=1/part", "../day", "day 2", "é" * 300):
        assert token_counts.commit(changes_of(spark, 3), store, name)
    before = token_counts.totals(spark, store)
    assert token_counts.fold(spark, store) == 1 == token_counts.fold(spark, store)
    assert [r.n_tokens for r in before.collect()] == [12]
    assert not token_counts.commit(changes_of(spark, 3), store, "day 2")
    token_counts.commit(changes_of(spark, -3), store, "gone")
    token_counts.commit(changes_of(spark, 1, None), store, "new cell")
    for number in (2, 2):
        found = {r.source: (r.n_docs, r.n_tokens) for r in token_counts.totals(spark, store).collect()}
        assert found == {"a": (5, 9), None: (1, 1)}
        assert token_counts.fold(spark, store) == number


def check_pieces(rows, pieces, tokenizer, window):
    ids = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    used = collections.defaultdict(collections.Counter)
    for p in pieces:
        assert p.length > 0
        own = [d for d in ids[p.doc_id] if len(d) == p.doc_tokens]
        digests = {zlib.crc32(np.array(d[p.start : p.start + p.length], "<u4").tobytes()) for d in own}
        assert p.ids_crc32 in digests
        for i in range(p.start, p.start + p.length):
            used[p.doc_id, p.doc_tokens][i] += 1
    for doc_id, texts in ids.items():
        for n in {len(d) for d in texts}:
            assert used[doc_id, n] == collections.Counter(dict.fromkeys(range(n), sum(len(d) == n for d in texts)))
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0  # no padding: all sequences are powers of two
        sizes.append(end)
    return sizes


def test_pieces(docs, tokenizer):
    pieces = packing.pack(docs, RANKS, window=128, group_tokens=3_000).collect()
    sizes = check_pieces(documents(), pieces, tokenizer, 128)
    assert np.mean(np.array(sizes) == 128) > 0.8


@pytest.mark.parametrize("name", ["odd", "clashing"])
def test_pieces_of_odd_rows(request, tokenizer, name):
    pieces = packing.pack(request.getfixturevalue(name), RANKS).collect()
    check_pieces(awkward(), pieces, tokenizer, 2048)


def test_nothing_to_pack(none):
    assert packing.pack(none, RANKS).count() == 0


def test_least_squares():
    rng = np.random.default_rng(0)
    found, matrix = packing.fillings()
    assert all(sum(members) == packing.CLASSES and len(members) <= packing.DEPTH for members in found)
    assert len(set(found)) == len(found)
    exact = np.zeros(matrix.shape[1])
    exact[rng.choice(len(exact), 12, replace=False)] = rng.integers(1, 50, 12)
    x = packing.nonnegative_least_squares(matrix, matrix @ exact)
    assert (x >= 0).all() and np.abs(matrix @ x - matrix @ exact).max() < 1e-6
    target = rng.uniform(0, 100, packing.CLASSES)
    x = packing.nonnegative_least_squares(matrix, target)
    gradient = matrix.T @ (target - matrix @ x)
    assert (x >= 0).all() and gradient.max() < 1e-5 and np.abs(gradient[x > 0]).max(initial=0) < 1e-5


def test_ids_equal_the_published_vocabulary(tokenizer):
    from starcast.llm.common import encoder

    texts = [text or "" for _, text, *_ in documents() + awkward()] + ["  \x00  <|end", "१२ ½ 𝔘𝔫𝔦 🙂🙂\r\n\t x"]
    assert [encoder(RANKS).encode_ordinary(t) for t in texts] == [
        e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)
    ]
