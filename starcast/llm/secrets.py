"""Finds credentials in texts: fixed patterns, and the format learned from what the patterns find.

1. One pass over the whole texts gives each document's base matches, its candidates (runs of at least ``MIN_LENGTH``
   credential characters, with a digit, that touch no base match), and its longest ordinary word.
2. The values of the base matches are the labelled credentials; ordinary words are the counterpart. From a sample of
   each, bounded by ``most_examples``, a prefix tree over character classes is built and its states are merged while
   their statistics are compatible (ALERGIA with Hoeffding bounds). That gives two probabilistic automata.
3. Every candidate of every document is scored: the log likelihood, in bits, of its format as a credential against that
   as an ordinary word. Candidates of at least ``min_bits`` are spans of kind ``grammar``.

The samples are the examples with the smallest hashes, so they depend on the texts only. Without base matches there is
nothing to learn from and no span of kind ``grammar``.

Null and empty texts have no spans. Repeated rows get equal results. Places count code points; ends are exclusive. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log, log2, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcast.llm.common import text_key, texts
from starcast.session import materialize

KINDS = ["assign", "access", "hex", "grammar"]
MIN_LENGTH = 20
MIN_BITS = 24.0
MOST_EXAMPLES = 2_000

ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A match of [0-9a-f]+ is a whole run, so one that is long enough is also one of this pattern.
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_LENGTH},}}")
WORD = re.compile(r"[^\W\d_]{8,}")

SPAN = "struct<kind: int, start: int, end: int, value: string>"
FOUND = f"doc_id long, text_key long, base array<{SPAN}>, candidates array<{SPAN}>, ordinary string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Kind (a place in ``KINDS``), start, end and value of the base matches, by start, then kind."""
    found = [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[1], span[0]))


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    runs = [m for m in RUN.finditer(text) if any(c.isdigit() for c in m[0])]
    return [(3, *m.span(), m[0]) for m in runs if not any(m.start() < e and s < m.end() for _, s, e, _ in base)]


def scan(docs: DataFrame) -> DataFrame:
    """Base matches, candidates and an ordinary word of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(text) for text in batch["text"]]
            candidates = [candidate_spans(text, own) for text, own in zip(batch["text"], base)]
            ordinary = [max(WORD.findall(text), key=len, default=None) for text in batch["text"]]
            yield batch.drop(columns="text").assign(base=base, candidates=candidates, ordinary=ordinary)

    return texts(docs).select("doc_id", text_key(), "text").mapInPandas(run, FOUND)


def symbol(c: str) -> str:
    """The class of a character: d digit, h a-f, l other small letter, H A-F, U other capital, else itself; x beyond ASCII."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "z":
        return "h" if c <= "f" else "l"
    if "A" <= c <= "Z":
        return "H" if c <= "F" else "U"
    return c if c < "\x80" else "x"


# How many characters a class holds; the other classes hold one.
CLASS_SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20, "x": 1_000}


class Automaton:
    """A deterministic probabilistic automaton: per state its visits, its ends, and counts and targets by symbol."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.visits, self.ends, self.next = [0], [0], [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.factor = sqrt(0.5 * log(2 / alpha))
        for example in sorted(examples):
            self._add([symbol(c) for c in example])
        self._merge_all()
        self.symbols = {s for state in self.seen for s in state}

    def _add(self, symbols: list[str]) -> None:
        state = 0
        self.visits[0] += 1
        for s in symbols:
            if s not in self.next[state]:
                self.next[state][s] = len(self.next)
                self.next.append({})
                self.seen.append({})
                self.visits.append(0)
                self.ends.append(0)
            self.seen[state][s] = self.seen[state].get(s, 0) + 1
            state = self.next[state][s]
            self.visits[state] += 1
        self.ends[state] += 1

    def _merge_all(self) -> None:
        """Breadth first: each state next to the settled ones joins the first compatible one, or is settled itself."""
        settled = [0]
        while True:
            fringe = [
                (source, s, target)
                for source in settled
                for s, target in sorted(self.next[source].items())
                if target not in settled
            ]
            if not fringe:
                return
            source, s, state = max(fringe, key=lambda edge: self.visits[edge[2]])
            for other in settled:
                if self._compatible(other, state):
                    self.next[source][s] = other
                    self._fold(other, state)
                    break
            else:
                settled.append(state)

    def _differs(self, a: int, b: int, in_a: int, in_b: int) -> bool:
        n, m = self.visits[a], self.visits[b]
        return abs(in_a / n - in_b / m) > self.factor * (1 / sqrt(n) + 1 / sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        compared = set()
        while pairs:
            a, b = pairs.pop()
            if (a, b) in compared:
                continue
            compared.add((a, b))
            if self._differs(a, b, self.ends[a], self.ends[b]):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                if self._differs(a, b, self.seen[a].get(s, 0), self.seen[b].get(s, 0)):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    pairs.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, target in self.next[b].items():
                self.seen[a][s] = self.seen[a].get(s, 0) + self.seen[b][s]
                if s in self.next[a]:
                    pairs.append((self.next[a][s], target))
                else:
                    self.next[a][s] = target

    def bits(self, text: str) -> float:
        """The log2 likelihood of a text. Symbols that a state has not seen get a small share and lead to the start."""
        state, total, kinds = 0, 0.0, len(self.symbols) + 2
        for c in text:
            s = symbol(c)
            share = (self.seen[state].get(s, 0) + 0.5) / (self.visits[state] + 0.5 * kinds)
            total += log2(share / CLASS_SIZES.get(s, 1))
            state = self.next[state].get(s, 0)
        return total + log2((self.ends[state] + 0.5) / (self.visits[state] + 0.5 * kinds))


def _examples(words: DataFrame, most: int) -> list[str]:
    """The ``most`` distinct words with the smallest hashes."""
    chosen = words.where("word IS NOT NULL").distinct().orderBy(F.xxhash64("word"), "word").limit(most)
    return [row.word for row in chosen.collect()]


def learn(found: DataFrame, most_examples: int) -> tuple[Automaton, Automaton] | None:
    values = found.select(F.explode("base.value").alias("word")).where("length(word) <= 512")
    credentials = _examples(values, most_examples)
    ordinary = _examples(found.select(F.col("ordinary").alias("word")), most_examples)
    return (Automaton(credentials), Automaton(ordinary)) if credentials and ordinary else None


def find_secrets(docs: DataFrame, min_bits: float = MIN_BITS, most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """``doc_id``, ``text_key`` and ``spans`` of each row: kind, start, end, value and ``bits`` (null for base matches)."""
    found = materialize(scan(docs), "secrets")
    models = learn(found, most_examples)
    schema = "doc_id long, text_key long, spans array<struct<kind: int, start: int, end: int, value: string, bits: double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for base, candidates in zip(batch["base"], batch["candidates"]):
                spans = [{**span, "bits": None} for span in base]
                for span in candidates if models else []:
                    bits = models[0].bits(span["value"]) - models[1].bits(span["value"])
                    if bits >= min_bits:
                        spans.append({**span, "bits": bits})
                rows.append(sorted(spans, key=lambda span: (span["start"], span["kind"])))
            yield batch[["doc_id", "text_key"]].assign(spans=rows)

    return found.select("doc_id", "text_key", "base", "candidates").mapInPandas(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per row the counts and a digest of the base matches, and all spans as ``kind:start:end``."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])

    def joined(spans: Column) -> Column:
        entries = F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"]))
        return F.array_join(entries, ",")

    spans = F.col("spans")
    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return find_secrets(docs).select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )
