"""Periodic runs in the words of a text, by minimizers at several scales.

A run is a stretch of words in which words ``period`` apart are identical,
which is at least ``exponent`` periods long and which no neighbouring word
continues. At scale S, for periods from S up to 2 S, every place is named by
the 2 S words that start there, so that inside a run the next place of the
same name lies exactly one period on. Of the names, only the minima of
windows (in a mixed order) are looked at; such windows repeat at period
distance inside a run, and a run is long enough to hold two of them, so each
run has a pair of equal minima next to each other that are one period apart.
These pairs are seeds; comparing words that far apart to both sides gives the
run. Periods too short for a scale are found by scanning their lags directly.

Names come from pairs of names of half the length, so they are equal if and
only if the words are: no run is missed or made up by a hash. At each scale
only texts long enough for a run of it are kept, so work follows the words.
Texts are independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw

#: The first scale; shorter periods are scanned lag by lag.
FIRST_SCALE = 8
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _short(words: np.ndarray, period: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of at least ``length`` words that repeat at this lag."""
    a, b = _stretches(words[period:] == words[:-period])
    long = b - a + period >= length
    return a[long], b[long] + period


def _reach(words: np.ndarray, x: int, lag: int, step: int) -> int:
    """How many words on from ``x`` in the direction of ``step`` equal the word ``lag`` places further right."""
    done, size = 0, 64
    while True:
        room = len(words) - lag - x - done if step > 0 else x - done + 1
        take = min(size, room)
        if take <= 0:
            return done
        low = x + done if step > 0 else x - done - take + 1
        differ = words[low : low + take] != words[low + lag : low + lag + take]
        differ = differ if step > 0 else differ[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + take, size * 2


def seeds(names: np.ndarray, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each pair of equal minima of windows of ``width`` names that are next to each other and from one to two scales apart."""
    if len(names) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = bw.mix((names + 1).astype(np.uint64))
    least = bw.sliding(order, width, True)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(bw.sliding(np.concatenate([edge, least, edge]), width, False) == order)
    at = at[np.argsort(names[at], kind="stable")]
    lag = np.diff(at)
    near = (names[at[1:]] == names[at[:-1]]) & (lag >= scale) & (lag < 2 * scale)
    return at[:-1][near], lag[near]


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that the seeds lie in; seeds of a run already found are passed over together."""
    found = []
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    i = 0
    while i < len(at):
        x, p = int(at[i]), int(lag[i])
        start, stop = x - _reach(words, x - 1, p, -1), x + _reach(words, x, p, 1)
        if stop + p - start >= max(exponent * p, least):
            found.append((start, stop + p, p))
        to = int(np.searchsorted(lag, p, side="right"))
        i = max(i + 1, i + int(np.searchsorted(at[i:to], stop)))
    return found


def find_runs(words: np.ndarray, first: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of all runs, by row, start and period.

    ``words`` holds the numbers of all rows' words, ``first`` where each row
    begins (and ends); ``exponent`` is at least 3.
    """
    size = np.diff(first)
    rows = np.arange(len(size))
    # each row is followed by a number of its own, so that no run leaves its row
    kept = np.insert(words.astype(np.int64), first[1:], int(words.max(initial=-1)) + 1 + rows)
    begin, names = first[:-1] + rows, kept
    runs: list[np.ndarray] = []

    def add(start: np.ndarray, end: np.ndarray, period: np.ndarray | int) -> None:
        row = np.searchsorted(begin, start, side="right") - 1
        runs.append(np.column_stack([rows[row], start - begin[row], end - start, np.broadcast_to(period, len(start))]))

    for p in range(1, FIRST_SCALE):
        if (size >= max(exponent * p, least)).any():
            add(*_short(kept, p, max(exponent * p, least)), p)
    scale, span = FIRST_SCALE, 1
    while True:
        # rows that are too short for a run of this scale go, with their names
        stay = size >= max(exponent * scale, least)
        if not stay.any():
            break
        if not stay.all():
            mask = np.repeat(stay, size + 1)
            kept, names = kept[mask], names[mask[: len(names)]]
            rows, size = rows[stay], size[stay]
            begin = np.cumsum(size + 1) - size - 1
        while span < 2 * scale:
            pair = names[:-span] * (int(names.max()) + 1) + names[span:]
            names, span = pd.factorize(pair)[0].astype(np.int64), 2 * span
        found = _extended(kept, *seeds(names, scale, (exponent - 3) * scale + 1), exponent, least)
        if found:
            start, end, period = np.array(found).T
            add(start, end, period)
        scale *= 2
    out = np.concatenate(runs) if runs else np.zeros((0, 4), np.int64)
    # a stretch that repeats at several lags has the smallest as its period, of which the others are multiples
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    new = np.append(True, (out[1:, :3] != out[:-1, :3]).any(axis=1))[: len(out)]
    out = out[new]
    return tuple(out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))].T)


def repeated_words(n: int, row_first: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, row_first[row] + start + period, 1)
    np.add.at(cover, row_first[row] + start + length, -1)
    return np.cumsum(cover)[:n] > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (start, length, period) by start and period, and the text collapsed.

    A run has at least ``exponent`` (3 or more) periods and ``least`` words; its
    period is its smallest. ``collapsed`` holds the words, joined by one space,
    that lie in no run after that run's first period. Null, empty and wordless
    texts have no words, no runs and an empty collapsed text; texts are read
    whole at any length; runs that overlap or tie are all returned; repeated
    rows and ids each return; null ids stay null; an empty table gives none.
    Other columns are not read.
    """
    if exponent < 3:
        raise ValueError("windows of equal minima are sure to repeat only in runs of three periods or more")
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            data, offsets = bw.buffer(batch.column("text"))
            begin, end, first = bw.words(data, offsets)
            row, start, length, period = find_runs(bw.codes(data, begin, end)[0], first, exponent, least)
            left = ~repeated_words(len(begin), first, row, start, length, period)
            text, s, e = bw.normalised(data, begin[left], end[left])
            count = np.searchsorted(np.flatnonzero(left), first)
            # a row's text ends before the space that follows its last word
            edge = np.append(s, len(text))
            collapsed = [text[edge[i] : e[j - 1]] if j > i else b"" for i, j in zip(count[:-1].tolist(), count[1:].tolist(), strict=True)]
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            at = pa.array(np.searchsorted(row, np.arange(len(first))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(first)), pa.ListArray.from_arrays(at, runs), pa.array([x.decode("utf-8") for x in collapsed], pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)
