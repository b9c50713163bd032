"""Packs documents into sequences of one length, with combinations of lengths found by non-negative least squares.

A document is the ids of its text and a closing id. Its full windows are sequences of their own. The remainders, all
shorter than a window, are packed group by group. A group is what one task has read until it holds ``group_tokens``
tokens of remainders, so memory is bounded whatever the size of the input, no row is shuffled, and a task that runs
again gives the same sequences. In each group:

1. Lengths are put into classes of ``window / CLASSES`` tokens, and every combination of at most ``DEPTH`` classes that
   fills the window is a column of a system whose right-hand side is the histogram of the classes.
2. Non-negative least squares gives the number of repeats of each combination; rounded down, they are laid out. A class
   stands for its longest length, so no sequence is too long, and each is short by less than ``DEPTH`` class widths.
3. The residuals are packed greedily: one after the other they fill what the sequences lack, then new sequences, and
   are cut where a sequence ends. If they do not suffice, the emptiest sequences are dissolved to fill the others.
4. What is left at the end of a group is less than a window; it is cut into sequences whose lengths are powers of two.

So no sequence needs padding, and few documents are cut besides those that are longer than a window.

A null or empty text is a document that holds the closing id only. Repeated rows are packed one by one. No rows give
no pieces. Sequence ids are unique within a run; they depend on how the input was split into tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from starcast.llm.common import encoder, texts

CLASSES = 64
DEPTH = 4
GROUP_TOKENS = 8_000_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame, ranks: str, window: int = 2048, closing_id: int = 1, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """The pieces of all documents. ``ranks``: the vocabulary's rank file, as each worker sees it.

    ``window`` is a power of two of at least ``CLASSES``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        held = 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text), closing_id], dtype="<u4")
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    rows.append(_piece(doc_id, ids, start, start + window, 0, len(ids), sequence, 0))
                    sequence += 1
                if whole < len(ids):
                    rests.append((doc_id, ids[whole:].copy(), whole, len(ids)))
                    held += len(ids) - whole
                if held >= group_tokens:
                    rows += _lay_out(rests, window, sequence)
                    sequence = rows[-1][5] + 1
                    rests, held = [], 0
            yield _frame(rows)
        if rests:
            yield _frame(_lay_out(rests, window, sequence))

    return texts(docs).mapInPandas(run, PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [field.split()[0] for field in PIECES.split(", ")]
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({name: "Int64" for name in names})


def _piece(doc_id, ids, start, end, before, n, sequence, offset) -> tuple:
    """The ids from ``start`` to ``end`` of ``ids``, which themselves begin at ``before`` of the document."""
    return doc_id, before + start, end - start, zlib.crc32(ids[start:end].tobytes()), n, sequence, offset


def _lay_out(rests: list[tuple], window: int, first: int) -> list[tuple]:
    """The pieces of a group of remainders. The last row has the last sequence id."""
    lengths = np.array([len(ids) for _, ids, _, _ in rests])
    sequences, residual = combine(lengths, window)
    # As many sequences as the tokens fill; the emptiest others give their documents to the residuals.
    filled = [int(lengths[members].sum()) for members in sequences]
    order = sorted(range(len(sequences)), key=lambda i: -filled[i])
    kept, dissolved = order[: int(lengths.sum()) // window], order[int(lengths.sum()) // window :]
    residual = sorted(residual + [i for s in dissolved for i in sequences[s]], key=lambda i: -lengths[i])
    rows, room = [], []
    for number, s in enumerate(kept):
        offset = 0
        for i in sequences[s]:
            doc_id, ids, before, n = rests[i]
            rows.append(_piece(doc_id, ids, 0, len(ids), before, n, first + number, offset))
            offset += len(ids)
        if offset < window:
            room.append((first + number, offset, window - offset))
    sequence = first + len(kept)
    left = int(lengths[residual].sum()) - sum(space for _, _, space in room)
    while left > 0:
        space = window if left >= window else 1 << (left.bit_length() - 1)
        room.append((sequence, 0, space))
        left, sequence = left - space, sequence + 1
    place = iter(room)
    target, offset, space = next(place, (0, 0, 0))
    for i in residual:
        doc_id, ids, before, n = rests[i]
        start = 0
        while start < len(ids):
            if not space:
                target, offset, space = next(place)
            end = min(len(ids), start + space)
            rows.append(_piece(doc_id, ids, start, end, before, n, target, offset))
            offset, space, start = offset + end - start, space - (end - start), end
    rows.sort(key=lambda row: row[5:])
    return rows


def combine(lengths: np.ndarray, window: int) -> tuple[list[list[int]], list[int]]:
    """Sequences of whole remainders, as lists of positions, and the remainders that no rounded combination takes."""
    classes = -(-lengths * CLASSES // window)
    repeats = solve(tuple(np.bincount(classes, minlength=CLASSES + 1)[1:].tolist()))
    by_class = [np.flatnonzero(classes == c).tolist() for c in range(CLASSES + 1)]
    sequences = []
    for members, n in repeats:
        for _ in range(n):
            if any(len(by_class[c]) < members.count(c) for c in members):
                break  # least squares may overshoot a class
            sequences.append([by_class[c].pop() for c in members])
    return sequences, [i for rest in by_class for i in rest]


@lru_cache(maxsize=1)
def fillings() -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All combinations of at most ``DEPTH`` classes that fill a window, and the matrix with a column for each."""
    found = _fillings(CLASSES, DEPTH, 1)
    matrix = np.zeros((CLASSES, len(found)))
    for column, members in enumerate(found):
        for c in members:
            matrix[c - 1, column] += 1
    return found, matrix


def _fillings(rest: int, depth: int, least: int) -> list[tuple[int, ...]]:
    found = [(rest,)] if rest >= least else []
    if depth > 1:
        for c in range(least, rest // 2 + 1):
            found += [(c, *more) for more in _fillings(rest - c, depth - 1, c)]
    return found


def solve(histogram: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often to repeat them: the solution of the least squares problem, rounded down."""
    found, matrix = fillings()
    solution = nonnegative_least_squares(matrix, np.array(histogram, dtype=float))
    whole = np.floor(solution + 1e-6).astype(int)
    return [(found[i], int(whole[i])) for i in np.flatnonzero(whole)]


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - target|, by active sets: a column enters while it lowers the error, and
    columns whose weight would turn negative leave."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(10 * len(target)):
        gradient = matrix.T @ (target - matrix @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, columns], target, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[columns] = trial
                break
            falling = trial <= 0
            step = float((x[columns][falling] / np.maximum(x[columns][falling] - trial[falling], 1e-300)).min())
            x[columns] += step * (trial - x[columns])
            gone = columns[falling & (x[columns] <= tolerance)]
            if not len(gone):
                gone = columns[falling]
            x[gone], active[gone] = 0, False
    return x
