"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Features are all words of the examples, and the beginnings of longer words, toxic or not. An example or a document is
the vector of its features with weights (1 + ln tf) * idf; what no example holds has no idf and does not count. Only
documents without any feature have no neighbours; their score is the share of toxic ones among examples without features.

The index holds the weights of common features in one matrix, with which a batch of documents is multiplied, and of all
other features the list of examples. Every example that shares a feature is scored: no bound is used, and the neighbours
are exact. Their labels vote with the weight 1 / (distance + 0.05), where the distance is 1 - cosine; the share of toxic
votes is turned into a score by the rates that the examples show when each is scored by the others. So is the number of
neighbours that vote chosen: the one of ``neighbours`` with the least logarithmic loss on the examples. The first ``k``
neighbours are the evidence.

Bound: ``most_examples`` examples, at most half of them of either label (distinct texts with the smallest hashes), so the
index that each task gets is bounded by their texts. Where a label has more texts than that, its examples count for as many
texts as they stand for when rates are taken. All else covers all rows.

Null and empty texts are scored like texts without features. Repeated rows get equal scores. Labels of 0 or 1 count,
others and null are left out; if a document is labelled twice, the larger label counts; if equal texts are, each
counts once per label. Without labelled examples of both kinds every score is the share of toxic ones, or 0.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from starcast.llm.common import append_columns
from starcast.session import materialize

K = 15
#: How many neighbours may vote.
NEIGHBOURS = (15, 31, 61)
# Documents multiplied at a time.
BATCH = 64
SHORTEST, LONGEST = 3, 8
# Features that more than one in so many examples hold are common: a product of matrices is cheaper than their lists.
COMMON = 10
MOST_EXAMPLES = 3_000
# Scores remembered in a task, for texts with equal counts.
REMEMBERED = 20_000
# Words, and longest beginnings of words, whose features are remembered in a task.
WORDS = 50_000
STRIPPED = ".,;:!?*#%$&|\"'()[]{}<>"


def features_of(word: str) -> list[str]:
    """The word itself and its proper beginnings, marked by a hyphen."""
    word = word.strip(STRIPPED)
    return [word, *(word[:n] + "-" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))] if word else []


#: Known features in ascending order, and how often a text has each.
Counted = tuple[np.ndarray, np.ndarray]


class Names:
    """The numbers of features, which are their places in a list, by hashes of 64 bits.

    Each task has all names of the index, and a dictionary of strings takes many times as much memory.
    """

    def __init__(self, names: Iterable[str]):
        hashes = np.fromiter(map(xxh3_64_intdigest, names), np.uint64)
        self.numbers = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.numbers]

    def __len__(self) -> int:
        return len(self.numbers)

    def found(self, names: list[str]) -> np.ndarray:
        """The number of each name, -1 if it is not known."""
        if not len(self):
            return np.full(len(names), -1, np.int32)
        hashes = np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))
        places = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        return np.where(self.hashes[places] == hashes, self.numbers[places], np.int32(-1))

    def numbers_of(self, names: list[str]) -> list[int]:
        """As :func:`found`."""
        return self.found(names).tolist()


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number

    def since(self, n: int) -> list[str]:
        """The keys from number ``n`` on."""
        return list(islice(reversed(self), len(self) - n))[::-1]


class Vocabulary:
    """The known features of words, as arrays: of each word its own feature, or -1, and the number of its longest beginning;
    of each beginning the features of it and of its own beginnings.

    New words wait until all texts of a batch are split, so they are looked up many at a time, and once for all texts.
    """

    def __init__(self, known: Names):
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.words, self.beginnings = Numbered(), Numbered()
        self.wholes, self.longest = np.empty(0, np.int32), np.empty(0, np.int32)
        self.ends, self.features = np.zeros(1, np.int64), np.empty(0, np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def look_up(self) -> None:
        """Finds the features of all words that are new."""
        wholes = [word.strip(STRIPPED) for word in self.words.since(len(self.wholes))]
        if not wholes:
            return
        longest = [whole[: min(LONGEST, len(whole) - 1)] if len(whole) > SHORTEST else "" for whole in wholes]
        longest = np.fromiter(map(self.beginnings.__getitem__, longest), np.int32, len(longest))
        self.wholes = np.concatenate([self.wholes, self.known.found(wholes)])
        self.longest = np.concatenate([self.longest, longest])
        starts = self.beginnings.since(len(self.ends) - 1)
        lengths = np.fromiter(map(len, starts), np.int64, len(starts))
        left, places, found = np.arange(len(starts)), [], []
        for n in range(SHORTEST, LONGEST + 1):
            left = left[lengths[left] >= n]
            features = self.known.found([starts[place][:n] + "-" for place in left.tolist()])
            # What follows a beginning that is not known is not known either.
            left, features = left[features >= 0], features[features >= 0]
            places.append(left)
            found.append(features)
        places = np.concatenate(places)
        order = np.argsort(places, kind="stable")
        self.features = np.concatenate([self.features, np.concatenate(found)[order]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(places, minlength=len(starts)))])

    def counted(self, numbers: np.ndarray) -> Counted:
        """The features of a text, given the numbers of its words."""
        words, times = np.unique(numbers, return_counts=True)
        wholes, longest = self.wholes[words], self.longest[words]
        starts, ends = self.ends[longest], self.ends[longest + 1]
        own = wholes >= 0
        features = np.concatenate([wholes[own], self.features[_places(starts, ends)]]).astype(np.int64)
        # Numbers of features and counts are sorted as one number.
        both = np.sort(features << 32 | np.concatenate([times[own], np.repeat(times, ends - starts)]))
        features = both >> 32
        firsts = np.flatnonzero(np.diff(features, prepend=-1))
        return features[firsts], np.add.reduceat(both & 0xFFFFFFFF, firsts) if len(firsts) else np.empty(0, np.int64)


class Remembered(dict):
    """What ``of_word`` gives for each word, kept."""

    def __init__(self, of_word: Callable[[str], Sequence]):
        self.of_word = of_word

    def __missing__(self, word: str) -> Sequence:
        self[word] = found = self.of_word(word)
        return found


class Counts:
    """Counts of known features in texts. What a word stands for is remembered up to a bound.

    ``known`` holds, as :func:`features_in` finds them, all shorter beginnings of each beginning.
    """

    def __init__(self, known: Names | dict[str, int] | None):
        self.known = known
        self.vocabulary = Vocabulary(known) if isinstance(known, Names) else None
        self.words = Remembered(features_of if known is None else self._known_of)

    def _known_of(self, word: str) -> tuple[int, ...]:
        known, word = self.known, word.strip(STRIPPED)
        found = [known[word]] if word in known else []
        for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1):
            number = known.get(word[:n] + "-")
            if number is None:
                break
            found.append(number)
        return tuple(found)

    def _of_words(self, words: Iterable[str]) -> list[Sequence]:
        if len(self.words) > WORDS:
            self.words.clear()
        return list(map(self.words.__getitem__, words))

    def names(self, text: str) -> set[str]:
        """The features of a text, whether or not they are known."""
        return set(chain.from_iterable(self._of_words(set(text.lower().split()))))

    def __call__(self, text: str) -> Counted:
        return self.of_texts([text])[0]

    def of_texts(self, texts: Iterable[str]) -> list[Counted]:
        """The counts of each text; with :class:`Names` new words are looked up once for all of them."""
        if self.vocabulary is None:
            return list(map(self._of_text, texts))
        if len(self.vocabulary.words) > WORDS:
            self.vocabulary.clear()
        numbers = [self.vocabulary.numbers(text.lower().split()) for text in texts]
        self.vocabulary.look_up()
        return list(map(self.vocabulary.counted, numbers))

    def _of_text(self, text: str) -> Counted:
        words = Counter(text.lower().split())
        parts = self._of_words(words)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        features = np.fromiter(chain.from_iterable(parts), np.int64, lengths.sum())
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), lengths)
        order = np.argsort(features)
        features = features[order]
        starts = np.flatnonzero(np.append(True, features[1:] != features[:-1])) if len(features) else np.empty(0, np.int64)
        return features[starts], np.add.reduceat(times[order], starts) if len(starts) else np.empty(0, np.int64)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, most: int) -> tuple[DataFrame, dict[int, float]]:
    """Distinct texts with their label, ``toxic``, of the rows that ``usable``, a condition on ``doc_id``, admits, and for
    how many texts each one of a label stands.

    Of more than ``most // 2`` of a label, those with the smallest hashes (their lower halves first).
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("hash")).join(known, "doc_id")
    # One document for each text and label; only ids and hashes are shuffled.
    single = materialize(hashed.groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled")
    sizes = {row["toxic"]: row["count"] for row in single.groupBy("toxic").count().collect()}
    low = F.pmod("hash", F.lit(1 << 32))
    parts = []
    for toxic in (0, 1):
        share = min(1.0, 2 * (most // 2) / max(1, sizes.get(toxic, 0)))
        own = single.where((F.col("toxic") == toxic) & (low <= int(share * (1 << 32))))
        parts.append(own.orderBy(low, "hash").limit(most // 2))
    # At most ``most`` rows of three numbers, so the texts need no shuffle.
    chosen = parts[0].unionByName(parts[1])
    texts = rows.join(F.broadcast(chosen), (rows["doc_id"] == chosen["doc_id"]) & (F.xxhash64("text") == chosen["hash"]))
    return texts.select("text", "toxic").distinct(), {t: max(1.0, n / (most // 2)) for t, n in sizes.items()}


def features_in(examples: DataFrame) -> pd.DataFrame:
    """``feature`` and ``df``, the number of examples that have it, of all features of the examples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(None)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(counts.names(text))
                if len(seen) > 200_000:
                    yield _counts_frame(seen)
                    seen = Counter()
            yield _counts_frame(seen)

    n, toxic = examples.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return pd.DataFrame({"feature": [], "df": []})
    counted = examples.select("text").mapInPandas(run, "feature string, df long").groupBy("feature")
    table = counted.agg(F.sum("df").alias("df")).toArrow()
    return table.sort_by("feature").to_pandas()


def _counts_frame(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"feature": list(seen.keys()), "df": list(seen.values())}).astype({"feature": object, "df": "int64"})


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """Labelled examples: common features as a matrix, all others feature by feature."""

    known: Names
    idf: np.ndarray
    labels: np.ndarray
    #: What codes stand for, 1 + ln of it, and each example's length.
    tf: np.ndarray
    gains: np.ndarray
    norms: np.ndarray
    #: The examples of a feature, and codes: from ``starts[feature]`` on.
    starts: np.ndarray
    examples: np.ndarray
    codes: np.ndarray
    #: Number among the common features, or -1.
    common: np.ndarray
    bare_rate: float
    edges: np.ndarray
    rates: np.ndarray
    #: How many neighbours vote.
    voters: int = K

    def __post_init__(self) -> None:
        #: Each common feature's share of the cosine for a query weight of 1, by its number and example.
        often = np.flatnonzero(self.common >= 0)
        self.table = np.zeros((len(often), len(self.labels)))
        for number, f in enumerate(often.tolist()):
            places = slice(*self.starts[f : f + 2])
            examples = self.examples[places]
            self.table[number, examples] = self.gains[self.codes[places]] * self.idf[f] / self.norms[examples]

    def __getstate__(self) -> dict:
        """Without what follows from the rest."""
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def vector(self, counts: Counted) -> tuple[np.ndarray, np.ndarray]:
        features, tf = counts
        weights = (1 + np.log(tf)) * self.idf[features]
        return features, weights / np.linalg.norm(weights)

    def nearest(self, counts: Counted, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples with the largest cosine, and the cosine; of equal ones those that come first."""
        return self.nearest_of([counts], k, [without])[0]

    def nearest_of(self, batch: list[Counted], k: int, without: list[int]) -> list[list[tuple[float, int]]]:
        """``nearest`` for each of a batch."""
        vectors = [self.vector(counts) for counts in batch]
        queries = np.zeros((len(batch), len(self.table)))
        for query, (features, weights) in zip(queries, vectors):
            numbers = self.common[features]
            query[numbers[numbers >= 0]] = weights[numbers >= 0]
        return [
            self._best(scores, features, weights, k, own)
            for scores, (features, weights), own in zip(queries @ self.table, vectors, without)
        ]

    def _best(self, scores: np.ndarray, features: np.ndarray, weights: np.ndarray, k: int, without: int) -> list:
        rare = self.common[features] < 0
        features, weights = features[rare], weights[rare]
        starts, ends = self.starts[features], self.starts[features + 1]
        places = _places(starts, ends)
        # Each task has its own index, and weights of all postings would take more memory than the postings.
        parts = np.repeat(weights * self.idf[features], ends - starts) * self.gains[self.codes[places]]
        scores = scores + np.bincount(self.examples[places], parts, len(self.labels)) / self.norms
        if without >= 0:
            scores[without] = 0
        # Cosines compare by nine digits, so more than k may stand as high as the k-th.
        least = np.partition(scores, -k)[-k] - 2e-9 if len(scores) > k else 0.0
        high = np.flatnonzero((scores > 0) & (scores >= least))
        cosines = np.round(scores[high], 9)
        best = np.argsort(-cosines, kind="stable")[:k]
        return list(zip(high[best].tolist(), cosines[best].tolist()))

    def votes(self, neighbours: list[tuple[int, float]]) -> float:
        weights = np.array([1 / (1.05 - cosine) for _, cosine in neighbours])
        return float(weights @ self.labels[[e for e, _ in neighbours]] / weights.sum())

    def scores(self, batch: list[Counted], k: int) -> list[tuple[float, list[tuple[int, float]]]]:
        """The score of each of a batch, and its first ``k`` neighbours."""
        results: list[tuple[float, list[tuple[int, float]]]] = [(self.bare_rate, [])] * len(batch)
        filled = [i for i, (features, _) in enumerate(batch) if len(features)]
        for start in range(0, len(filled), BATCH):
            some = filled[start : start + BATCH]
            found = self.nearest_of([batch[i] for i in some], max(k, self.voters), [-1] * len(some))
            for i, neighbours in zip(some, found):
                if neighbours:
                    place = np.searchsorted(self.edges, self.votes(neighbours[: self.voters]), side="right")
                    results[i] = float(self.rates[place]), neighbours[:k]
        return results


def build(examples: list[tuple[str, int]], features: pd.DataFrame, k: int) -> Index:
    """The index of a bounded number of examples, with its calibration."""
    index = gather(examples, features, {})
    calibrate(index, (k,), shares_of(index, range(len(index.labels)), (k,)), {})
    return index


def gather(texts: Iterable[tuple[str, int]], features: pd.DataFrame, stands_for: dict[int, float]) -> Index:
    """The index before its calibration. The texts are read once, one at a time."""
    known = Names(features["feature"])
    counts = Counts(known)
    names, times, labels, bare, seen = [], [], [], [], set()
    for text, toxic in texts:
        own, tf = counts(text)
        if not len(own):
            bare.append(toxic)
            continue
        names.append(own.astype(np.int32))
        times.append(tf.astype(np.int32))
        seen.update(np.unique(tf).tolist())
        labels.append(toxic)
    n, df = len(labels), features["df"].to_numpy(np.float64)
    idf = np.log(1 + (n + len(bare)) / df) if len(known) else np.empty(0)
    tf = np.array(sorted(seen), np.int64)
    gains = 1 + np.log(tf)
    sizes = np.zeros(len(known), np.int64)
    for own in names:
        sizes[own] += 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    example, codes = np.empty(starts[-1], np.min_scalar_type(n)), np.empty(starts[-1], np.min_scalar_type(len(tf)))
    norms, free = np.empty(n), starts[:-1].copy()
    for number in range(n):
        own, code = names[number], np.searchsorted(tf, times[number])
        norms[number] = np.linalg.norm(gains[code] * idf[own])
        example[free[own]], codes[free[own]] = number, code
        free[own] += 1
        names[number] = times[number] = None
    common = np.full(len(known), -1, np.int32)
    often = np.flatnonzero(df * COMMON > n + len(bare))
    common[often] = np.arange(len(often))
    weights = [stands_for.get(toxic, 1.0) for toxic in bare]
    bare_rate = (sum(w for w, toxic in zip(weights, bare) if toxic) + 0.5) / (sum(weights) + 1) if bare or labels else 0.0
    labels = np.array(labels, np.float64)
    edges, rates = np.empty(0), np.empty(1)
    return Index(known, idf, labels, tf, gains, norms, starts, example, codes, common, bare_rate, edges, rates)


def shares_of(index: Index, examples: Sequence[int], ks: Sequence[int]) -> list[list[float] | None]:
    """For each number of neighbours the share of toxic votes among the other examples; None without neighbours."""
    order = np.argsort(index.examples, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(index.examples, minlength=len(index.labels)))])
    shares: list[list[float] | None] = []
    for start in range(0, len(examples), BATCH):
        some, batch = list(examples[start : start + BATCH]), []
        for example in some:
            places = order[slice(*starts[example : example + 2])]
            features = np.searchsorted(index.starts, places, side="right") - 1
            batch.append((features, index.tf[index.codes[places]]))
        found = index.nearest_of(batch, max(ks), some)
        shares += [[index.votes(neighbours[:k]) for k in ks] if neighbours else None for neighbours in found]
    return shares


def calibrate(
    index: Index, ks: Sequence[int], found: list[list[float] | None], stands_for: dict[int, float]
) -> None:
    """Shares of votes to scores, by the number of neighbours that tells the examples apart best."""
    used = [i for i, shares in enumerate(found) if shares is not None]
    labels = index.labels[used] if used else np.empty(0)
    weights = np.where(labels == 1, stands_for.get(1, 1.0), stands_for.get(0, 1.0))
    edges = np.linspace(0, 1, 21)[1:-1]
    least = np.inf
    for number, k in enumerate(ks):
        shares = np.array([found[i][number] for i in used])
        place = np.searchsorted(edges, shares, side="right") if used else np.empty(0, np.int64)
        rates = _rising_rates(place, labels, weights)
        own = rates[place]
        loss = -float(weights @ np.log(np.where(labels == 1, own, 1 - own)))
        if loss < least:
            least, index.edges, index.rates, index.voters = loss, edges, rates, k


def _rising_rates(place: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rates in ranges of the share, made to rise by pooling neighbouring ranges."""
    middle = (np.arange(20) + 0.5) / 20
    # Each range starts with one example of its own share, so empty ranges keep it.
    weight = np.bincount(place, weights=weights, minlength=20) + 1.0
    rate = np.bincount(place, weights=weights * labels, minlength=20) + middle
    pools: list[list[float]] = []
    for total, n in zip(rate, weight):
        pools.append([total, n, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.concatenate([np.full(int(n), total / w) for total, w, n in pools])


def with_scores(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    k: int = K,
    most_examples: int = MOST_EXAMPLES,
    neighbours: Sequence[int] = NEIGHBOURS,
) -> DataFrame:
    """``docs`` plus ``llm_score`` and ``llm_evidence``, the label and the cosine of the ``k`` nearest examples."""
    usable = F.lit(True) if usable is None else usable
    texts, stands_for = labelled(docs, labels, usable, most_examples)
    examples = materialize(texts, "examples")
    features = features_in(examples)
    rows = examples.select("text", "toxic").coalesce(1).sortWithinPartitions("text", "toxic")
    index = gather(rows.toLocalIterator(), features, stands_for)
    del features
    shared = docs.sparkSession.sparkContext.broadcast(index)
    calibrate(index, neighbours, _shares(docs.sparkSession, shared, len(index.labels), neighbours), stands_for)
    edges, rates, voters = index.edges, index.rates, index.voters

    def compute() -> Callable[[list[str]], list[list]]:
        index = shared.value
        index.edges, index.rates, index.voters = edges, rates, voters
        counts, remembered = Counts(index.known), {}

        def run(texts: list[str]) -> list[list]:
            if len(remembered) > REMEMBERED:
                remembered.clear()
            keys, waiting = [], {}

            def work() -> None:
                for key, (score, neighbours) in zip(waiting, index.scores(list(waiting.values()), k)):
                    # As arrays: pairs of numbers take several times as much.
                    toxic = bytes(int(index.labels[e]) for e, _ in neighbours)
                    remembered[key] = score, toxic, array("d", [c for _, c in neighbours])
                waiting.clear()

            for first in range(0, len(texts), BATCH):
                for own in counts.of_texts(texts[first : first + BATCH]):
                    key = xxh3_128_digest(np.concatenate(own).tobytes())
                    keys.append(key)
                    if key not in remembered:
                        waiting[key] = own
                    if len(waiting) >= BATCH:
                        work()
            work()
            results = [remembered[key] for key in keys]
            return [[score for score, _, _ in results], [list(zip(toxic, cosines)) for _, toxic, cosines in results]]

        return run

    kind = "array<struct<toxic: int, cosine: double>>"
    return append_columns(docs, [("llm_score", "double"), ("llm_evidence", kind)], compute)


def _shares(spark: SparkSession, shared: Broadcast, n: int, ks: Sequence[int]) -> list[list[float] | None]:
    """``shares_of`` all examples, in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = [number for batch in batches for number in batch["id"].tolist()]
        if numbers:
            yield pd.DataFrame({"id": numbers, "shares": shares_of(shared.value, numbers, ks)})

    shares: list[list[float] | None] = [None] * n
    for number, found in spark.range(0, n).mapInPandas(run, "id long, shares array<double>").collect():
        shares[number] = found
    return shares


def held_out() -> Column:
    """Whether labels of a ``doc_id`` are kept for testing; a missing id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
