"""Finds documents that hold a benchmark item, also with small edits, by the q-gram lemma.

Texts and items are compared lower-cased, with each run of white space as one blank. An item of m characters occurs in
a text if some part of the text is within its edit budget of k = m / 10 (rounded down, and small enough that the lemma
still asks for a shared q-gram).

* Lemma: such a part shares at least m - q + 1 - k q of the item's q-grams, on diagonals (place in the text minus place
  in the item) that differ by at most 2 k. Diagonals are cut into bands of 2 (2 k + 1), each overlapping the next by
  half, so that one band has all of them.
* Bands with that many shared q-grams are verified by an alignment limited to the band's diagonals.

The items are read in blocks of a bounded number of characters, and the documents pass once for each block; nothing
is shuffled, however often an item or a q-gram occurs. Texts are handled whole, in pieces of bounded size that overlap
by the length of the longest item and its budget.

Null or empty texts and items match nothing. Items shorter than a q-gram must occur exactly. Repeated rows each get the
same result, equal items each count, and columns of ``docs`` stay as they are. Without items no document has a match;
without documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.llm.common import append_columns

Q = 8
BLOCK_CHARS = 2_000_000
PIECE_CHARS = 1_000_000
SLOTS = 1 << 22
NEVER = np.int32(1 << 28)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for the q-gram at each place, built from hashes of 1, 2 and 4 characters."""
    hashes = codes.astype(np.uint64) * _A
    length = 1
    while length < Q and len(hashes) > length:
        hashes = hashes[:-length] * _A + hashes[length:] * _B
        hashes ^= hashes >> np.uint64(29)
        length *= 2
    return hashes if length == Q else hashes[:0]


def edit_budget(m: int) -> int:
    return min(m // 10, (m - Q) // Q)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short = [(i, text) for i, text in items if len(text) < Q]
        long = [(i, text) for i, text in items if len(text) >= Q]
        self.ids = [i for i, _ in long]
        self.codes = [code_points(text) for _, text in long]
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(int(m)) for m in self.length], np.int64)
        self.width = 2 * self.budget + 1
        self.least = self.length - Q + 1 - self.budget * Q
        grams = [qgram_hashes(c) for c in self.codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        hashes = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(hashes)))
        self.seen = np.zeros(SLOTS, bool)
        self.seen[self.grams & np.uint64(SLOTS - 1)] = True
        self.reach = int((self.length + 3 * self.width).max(initial=0))

    def bands(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of document, item and first diagonal of the bands with enough shared q-grams.

        ``bounds``: where each document starts in ``codes``, and the end of the last one.
        """
        hashes = qgram_hashes(codes)
        at = np.flatnonzero(self.seen[hashes & np.uint64(SLOTS - 1)])
        known = np.searchsorted(self.grams, hashes[at])
        known[known == len(self.grams)] = 0
        same = self.grams[known] == hashes[at] if len(self.grams) else np.zeros(len(at), bool)
        at, known = at[same], known[same]
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + Q <= bounds[doc + 1]
        at, known, doc = at[inside], known[inside], doc[inside]
        # A key for each shared q-gram: document, item and band, in one number.
        n_items, span = len(self.ids), int(bounds[-1]) + 2 * self.reach + 2
        found = []
        for start in range(0, len(at), 500_000):  # a q-gram can stand in many items
            part = slice(start, start + 500_000)
            n = self.count[known[part]]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            entry = np.repeat(self.first[known[part]], n) + offset
            item = self.item[entry]
            diagonal = np.repeat(at[part] - bounds[doc[part]], n) - self.place[entry]
            band = diagonal // self.width[item] + self.reach + 1
            found.append(_counted((np.repeat(doc[part], n) * n_items + item) * span + band))
        if not found:
            return np.empty((0, 3), np.int64)
        keys, counts = found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found)))
        # A band holds the diagonals of its own number and of the next one.
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        both = counts + np.where(follows, np.append(counts[1:], 0), 0)
        bare = np.append(True, keys[1:] != keys[:-1] + 1)
        keys, counts = np.concatenate([keys, keys[bare] - 1]), np.concatenate([both, counts[bare]])
        enough = counts >= self.least[keys // span % n_items]
        keys = keys[enough]
        item = keys // span % n_items
        return np.column_stack([keys // span // n_items, item, (keys % span - self.reach - 1) * self.width[item]])

    def verified(self, codes: np.ndarray, bounds: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """The least edit distance in each band within the item's budget, by aligning many bands at once, row by row of
        the items. Bands that exceed the budget leave early and get a distance beyond any."""
        distance = np.full(len(bands), NEVER, np.int32)
        for start in range(0, len(bands), 512):
            part = bands[start : start + 512]
            doc, item, low = part.T
            m, budget, diagonals = self.length[item], self.budget[item], 2 * self.width[item] - 1
            span, rows = int(diagonals.max()), int(m.max())
            # text[b, x]: the character at low + x of the band's document, if it has one.
            places = (bounds[doc] + low)[:, None] + np.arange(rows + span)
            outside = (places < bounds[doc][:, None]) | (places >= bounds[doc + 1][:, None])
            text = codes[np.clip(places, 0, len(codes) - 1)]
            patterns = np.zeros((len(part), rows), np.uint32)
            for row, i in enumerate(item):
                patterns[row, : m[row]] = self.codes[i]
            steps = np.arange(span, dtype=np.int32)
            beyond = steps >= diagonals[:, None]
            # Before the first row an alignment may start at any place of the text.
            cost = np.where(beyond | (low[:, None] + steps < 0), NEVER, np.int32(0))
            alive = np.arange(len(part))
            for j in range(rows):
                # A character of the item meets one of the text, or is left out, or one of the text is put in.
                new = cost + (text[:, j : j + span] != patterns[:, j : j + 1])
                new[outside[:, j : j + span]] = NEVER
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                new[beyond] = NEVER
                new = np.minimum.accumulate(new - steps, axis=1) + steps
                new[beyond] = NEVER
                cost = new
                ended = m == j + 1
                if ended.any():
                    distance[start + alive[ended]] = cost[ended].min(axis=1)
                if ended.any() or j % 8 == 7:
                    on = (m > j + 1) & (cost.min(axis=1) <= budget)
                    if not on.any():
                        break
                    if not on.all():
                        text, outside, patterns, beyond = text[on], outside[on], patterns[on], beyond[on]
                        cost, m, budget, alive = cost[on], m[on], budget[on], alive[on]
        return distance

    def matches(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text the items it holds with their least distance, by item."""
        found: list[dict[int, int]] = [{} for _ in texts]
        for held, codes, bounds in self._pieces(texts):
            bands = self.bands(codes, bounds)
            distance = self.verified(codes, bounds, bands)
            near = distance <= self.budget[bands[:, 1]]
            for (doc, item, _), d in zip(bands[near], distance[near]):
                own = found[held[doc]]
                own[int(item)] = min(int(d), own.get(int(item), int(d)))
        result = [[(self.ids[item], d) for item, d in own.items()] for own in found]
        for i, short in self.short:
            for own, text in zip(result, texts):
                if short and short in normalized(text):
                    own.append((i, 0))
        return [sorted(own) for own in result]

    def _pieces(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Texts put together up to ``PIECE_CHARS``; longer ones in overlapping pieces."""
        held, parts, size = [], [], 0
        for i, text in enumerate(texts):
            codes = code_points(normalized(text))
            for start in range(0, max(1, len(codes) - self.reach), PIECE_CHARS):
                part = codes[start : start + PIECE_CHARS + self.reach]
                held.append(i)
                parts.append(part)
                size += len(part)
                if size >= PIECE_CHARS:
                    yield held, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                    held, parts, size = [], [], 0
        if held:
            yield held, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often they occur."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters (or one item), read partition by partition."""
    block, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL")
    for item_id, text in rows.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = normalized(text)
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def with_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` plus ``llm_items``: structs of ``item_id`` and ``distance`` of the items each text holds, by item."""
    kind = "array<struct<item_id: long, distance: long>>"
    result = docs.withColumn("llm_items", F.array().cast(kind))
    for block in item_blocks(benchmark):

        def compute(block=block):
            index = Index(block)
            return lambda batch: [index.matches(batch)]

        result = append_columns(result, [("llm_found", kind)], compute)
        result = result.withColumn("llm_items", F.array_sort(F.concat("llm_items", "llm_found"))).drop("llm_found")
    return result
