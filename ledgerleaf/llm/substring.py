"""Substring dedup by seed and extend over winnowed anchors.

Seeds: of the hashes of all runs of ``SEED`` words, the least in each window
is an anchor, so two equal windows hold the same anchors at the same places.
Documents are joined on anchors; those that occur once end here.

Extend: each occurrence of a shared anchor is extended both ways over the
windows whose least seed it is: a stretch of words. Equal stretches meet
first; a stretch that occurs again is settled as a whole. Of those that occur
once the reach of the match is found window by window, against one of each
group of equal stretches and all single ones. The union of what matches,
merged where it overlaps, is the set of maximal repeats over the length
threshold.

Only whether a stretch or window occurs again matters, so copies that meet in
one task are settled there, and one row stands for them in the shuffle. A key
of any number of copies so costs a task one row for each ``CHUNK`` rows of
others, and there is one way for all of them. Only what shares an anchor is
compared, by 64 bits of hash beside the anchor's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.staging import drop, free_shuffles, staged

_U = np.uint64
#: Words of a seed: long enough that chance repeats are rare, short enough that anchors are few.
SEED = 14
#: Rows among which a task looks for copies at a time.
CHUNK = 50_000
_KEYED = pa.schema([("m_row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int8()), ("inner", pa.binary())])


def _anchors(values: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of its first word, hash) of each anchor of rows whose word hashes are ``values``."""
    runs = bw.hash_runs(values, seed)
    width = window - seed + 1
    whole = _inside(first, window, len(values))
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = bw.sliding(runs, width, True)
    # a place is an anchor if the greatest of the minima of the whole windows over it is its own hash
    least = np.where(whole[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((bw.sliding(padded, width, False) == runs) & (runs > 0))
    return chosen, runs[chosen]


def _inside(first: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each place from 0 to n - window: does a window that starts there end in the same row?"""
    if n < window:
        return np.zeros(0, bool)
    row_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n - window + 1) + window <= row_end[: n - window + 1]


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = bw.buffer(column)
    start, end, first = bw.words(data, offsets)
    return data, start, end, first, bw.hash_spans(data, start, end)


def _stretches(values: np.ndarray, first: np.ndarray, marks: pa.Array, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, number of windows, seed) of each run of windows in one row that have the same least seed, if that is in the row's ``marks``."""
    whole = _inside(first, window, len(values))
    if not whole.any():
        return *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64)
    width = window - seed + 1
    at = np.flatnonzero(whole)
    least = bw.sliding(bw.hash_runs(values, seed), width, True)[at]
    row = np.searchsorted(first, at, side="right") - 1
    pair = lambda r, x: bw.mix(x + bw.MULTIPLIER * r.astype(np.uint64))
    size = np.where(marks.is_valid().to_numpy(zero_copy_only=False), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    hit = np.isin(pair(row, least), pair(np.repeat(np.arange(len(size)), size), marks.flatten().to_numpy().view(np.uint64)))
    at, least, row = at[hit], least[hit], row[hit]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0) | (least[1:] != least[:-1])) if len(at) else np.zeros(0, bool)
    place = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    begin = np.flatnonzero(place % width == 0)  # equal seeds in a row would make a stretch of any length
    return row[begin], at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _stretch_keys(hashes: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A hash of ``m`` consecutive window hashes from each place of ``at`` on."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * bw.powers(bw.MULTIPLIER, len(hashes)), dtype=np.uint64, out=total[1:])
    return bw.mix((total[at + m] - total[at]) * bw.powers(bw.INVERSE, len(hashes) + 1)[at] + m.astype(np.uint64))


def _keyed(row: pa.Array, start: np.ndarray, end: np.ndarray, k1: np.ndarray, k2: np.ndarray, n: np.ndarray, inner: pa.Array | None = None) -> pa.RecordBatch:
    ints = [pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n.astype(np.int8))]
    return pa.RecordBatch.from_arrays([row, *ints, inner if inner is not None else pa.nulls(len(start), pa.binary())], schema=_KEYED)


def _told(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(spans that occur again, one row for each key in order): n is the number of copies, at most 2; a row with n of 2 stands for rows that are settled.

    Rows without a key are spans that were settled before, and pass.
    """
    done = rows.filter(rows.column("k1").is_null())
    rows = rows.filter(rows.column("k1").is_valid()).combine_chunks()
    if not rows.num_rows:
        return done, rows
    k1, k2, n = (rows.column(c).to_numpy() for c in ("k1", "k2", "n"))
    order = np.lexsort((k2, k1))
    new = np.append(True, (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0))
    total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
    again = order[(n[order] == 1) & (total[np.cumsum(new) - 1] > 1)]
    spans = rows.select(["m_row", "start", "end"]).take(pa.array(again))
    for name in ("k1", "k2", "n", "inner"):
        spans = spans.append_column(_KEYED.field(name), pa.nulls(len(again), _KEYED.field(name).type))
    one = rows.take(pa.array(order[new])).set_column(5, _KEYED.field("n"), pa.array(np.minimum(total, 2).astype(np.int8)))
    return pa.concat_tables([done, spans]), one


def _combined(parts: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Before a shuffle: settles the copies that meet among ``chunk`` rows, and leaves one row for them."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.num_rows
        if size >= chunk:
            done, rest = _told(pa.Table.from_batches(held, _KEYED))
            yield from done.to_batches()
            held, size = rest.to_batches(), rest.num_rows
            if 2 * size > chunk:
                yield from held
                held, size = [], 0
    if held:
        for table in _told(pa.Table.from_batches(held, _KEYED)):
            yield from table.to_batches()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """After a shuffle, rows in the order of their keys: (spans that occur again, one row for each key), the last key held back until it is whole."""
    last = _KEYED.empty_table()
    for batch in batches:
        done, rest = _told(pa.concat_tables([last, pa.Table.from_batches([batch]).cast(_KEYED)]))
        last = rest.slice(max(rest.num_rows - 1, 0))
        yield done, rest.slice(0, max(rest.num_rows - 1, 0))
    yield _KEYED.empty_table(), last


def _windows(stretches: pa.Table, window: int) -> pa.RecordBatch:
    """A row for each window of each stretch."""
    inner = stretches.column("inner").to_pylist()
    m = np.array([len(x) // 8 for x in inner], np.int64)
    which = np.repeat(np.arange(len(m)), m)
    start = stretches.column("start").to_numpy()[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
    row, seed, n = (stretches.column(c).to_numpy()[which] for c in ("m_row", "k2", "n"))
    return _keyed(pa.array(row), start, start + window, np.frombuffer(b"".join(inner), np.uint64), seed, n)


def repeated_spans(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, chunk: int = CHUNK, unique: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, text_hash, text, n_words and repeats, (start, end) word ranges that may overlap.

    A word range belongs to a repeat if a window of ``window`` words that
    covers it starts anywhere else too, the same row included. Null texts
    have no words. Repeated rows, even of one id, count as elsewhere.
    text is null where there are no repeats and kept_sha256 is set there
    instead, so that clean texts are not written again.
    """
    seed = min(seed, window)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (F.lit(0).cast("long") if unique else F.xxhash64(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            _, _, _, first, values = _hashed(batch.column("text"))
            at, h = _anchors(values, first, window, seed)
            row = np.searchsorted(first, at, side="right") - 1
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(h) != 0))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(h)))
            took = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(took), batch.column("text_hash").take(took), pa.array(h[new].view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int8))], ["id", "text_hash", "h", "times"])

    found = staged(rows.mapInArrow(seeds, f"id {kind}, text_hash long, h long, times byte"), "seeds")
    free_shuffles(docs.sparkSession)
    shared = staged(found.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h"), "shared")
    marks = found.select("id", "text_hash", "h").join(shared.hint("merge"), "h")
    marks = marks.groupBy(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash")).agg(F.collect_set("h").alias("marks"))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            data, start, end, first, values = _hashed(batch.column("text"))
            row, at, m, h = _stretches(values, first, batch.column("marks"), window, seed)
            cut = np.searchsorted(row, np.arange(len(first)))
            listed = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x))  # noqa: B023, E731
            busy = cut[1:] > cut[:-1]
            text, s, e = bw.normalised(data, start, end)
            plain = [None if b else hashlib.sha256(text[s[i] : e[j - 1]] if j > i else b"").hexdigest() for b, i, j in zip(busy.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
            texts = batch.column("text").take(pa.array(np.arange(len(busy)), mask=~busy))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), texts, pa.array(np.diff(first)), pa.array(plain, pa.string()), listed((at - first[row]).astype(np.int32)), listed(m.astype(np.int32)), listed(h.view(np.int64))],
                ["id", "text_hash", "text", "n_words", "kept_sha256", "at", "m", "h"],
            )

    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))
    joined = rows.join(marks.hint("merge"), same, "left").select("id", "text_hash", "text", "marks")
    ext = joined.mapInArrow(context, f"id {kind}, text_hash long, text string, n_words long, kept_sha256 string, at array<int>, m array<int>, h array<long>")
    # once written, a row has a number of its own, which stretches carry in place of id and hash
    ext = staged(ext.withColumn("row", F.monotonically_increasing_id()), "contexts")
    drop(found)
    drop(shared)
    free_shuffles(docs.sparkSession)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in bw.slices(batches, "text"):
                _, _, _, first, values = _hashed(batch.column("text"))
                hashes = bw.hash_runs(values, window)
                count = batch.column("at").value_lengths().to_numpy()
                at, m = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "m"))
                place = at + np.repeat(first[:-1], count)
                inside, begin = bw.spans(place, place + m)
                inner = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * np.append(begin, len(inside))).astype(np.int32)), pa.py_buffer(hashes[inside])])
                row = batch.column("row").take(pa.array(np.repeat(np.arange(len(count)), count)))
                yield _keyed(row, at, at + m - 1 + window, _stretch_keys(hashes, place, m), batch.column("h").flatten().to_numpy(), np.ones(len(at)), inner)

        return _combined(each(), chunk)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for done, rest in _gathered(batches):
                yield from done.to_batches()
                for low in range(0, rest.num_rows, 4096):
                    yield _windows(rest.slice(low, 4096), window)

        return _combined(each(), chunk)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, _ in _gathered(batches):
            yield from done.select(["m_row", "start", "end"]).to_batches()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.coalesce("k1", "m_row")).sortWithinPartitions("k1", "k2")

    kinds = "m_row long, start int, end int, k1 long, k2 long, n byte, inner binary"
    hits = ext.where(F.size("at") > 0).select("row", "text", "at", "m", "h").mapInArrow(stretches, kinds)
    hits = staged(dealt(dealt(hits).mapInArrow(windows, kinds)).mapInArrow(settled, "m_row long, start int, end int"), "matches")
    free_shuffles(docs.sparkSession)
    hits = hits.groupBy("m_row").agg(F.collect_list(F.struct("start", "end")).alias("repeats"))
    base = ext.select("row", "id", "text_hash", "text", "n_words", "kept_sha256")
    return base.join(hits.hint("merge"), F.col("row") == F.col("m_row"), "left").select("id", "text_hash", "text", "n_words", "kept_sha256", "repeats")


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, chunk: int = CHUNK, unique: bool = False) -> DataFrame:
    """Remove every word covered by a repeated window: id, n_words, n_removed, kept_sha256, spans and kept.

    kept holds the words left, joined by one space, where any were removed,
    and null where none were (the text stands). spans are the maximal repeats
    as (start, end) word ranges, end exclusive. Null texts have no words and
    stay; texts shorter than the window stay; repeated rows lose each copy's
    words; an empty table gives none; other columns are not read. With
    ``unique``, ids tell rows apart and are not null, so no hash of the text
    is carried beside them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            removed, sha, kept = _cut(batch)
            ranges = [_spans(r) for r in removed]
            offsets = np.cumsum([0, *(len(r) for r in ranges)])
            flat = np.concatenate(ranges) if ranges else np.zeros((0, 2), np.int64)
            pair = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32))], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), batch.column("n_words"), pa.array([int(r.sum()) for r in removed], pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pair), pa.array(kept, pa.string())],
                ["id", "text_hash", "n_words", "n_removed", "kept_sha256", "spans", "kept"],
            )

    rows = repeated_spans(docs, window, id_col, text_col, seed, chunk, unique)
    out = rows.mapInArrow(remove, f"id {kind}, text_hash long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string")
    return out.withColumnRenamed("id", id_col)


def _cut(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[str], list[str | None]]:
    """For each row of a slice: which of its words go, the digest of the rest, and the rest if any went."""
    data, offsets = bw.buffer(batch.column("text"))
    start, end, first = bw.words(data, offsets)
    text, s, e = bw.normalised(data, start, end)
    repeats, given, count = batch.column("repeats"), batch.column("kept_sha256").to_pylist(), batch.column("n_words").to_pylist()
    removed, sha, kept = [], [], []
    for i in range(batch.num_rows):
        if given[i] is not None:  # a clean text, which was not written
            removed.append(np.zeros(count[i], bool))
            sha.append(given[i])
            kept.append(None)
            continue
        lo, hi = int(first[i]), int(first[i + 1])
        cover = np.zeros(hi - lo + 1, np.int64)
        if repeats[i].is_valid:
            ranges = repeats[i].values
            np.add.at(cover, ranges.field("start").to_numpy(), 1)
            np.add.at(cover, ranges.field("end").to_numpy(), -1)
        gone = np.cumsum(cover)[:-1] > 0
        removed.append(gone)
        left = " ".encode().join(text[a:b] for a, b in zip(s[lo:hi][~gone].tolist(), e[lo:hi][~gone].tolist(), strict=True)) if gone.any() else text[s[lo] : e[hi - 1]] if hi > lo else b""
        sha.append(hashlib.sha256(left).hexdigest())
        kept.append(left.decode("utf-8") if gone.any() else None)
    return removed, sha, kept


def _spans(gone: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)
