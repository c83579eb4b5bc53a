"""Benchmark decontamination over a distributed positional inverted index.

Index: the training documents are split into segments of a few megabytes, as
they lie; each segment stores its terms in order and, for each, the list of
places where it stands (differences, in bytes of 7 bits). Places run through
the segment's documents with a gap between them, so that no phrase crosses
one. Nothing is shuffled: a segment is one row of a written table, made and
searched in one task, however hot a term or a source is.

Search: benchmark texts become windows of words. A window without a place for
one of its terms in a segment ends there. For the others the lists are taken
from the rarest term of the segment up: the rarest term's places, moved by
the term's offset in the window, are the candidates, and each further list,
moved by its own offset, is intersected with them. What is left are exact
phrases. With ``slack``, each word may stand up to that many words from
its place in a window laid there: a proximity match.

The benchmark is cut into blocks of a bounded number of windows, and every
block meets every segment. Blocks are broadcast if they are within
``BROADCAST_BYTES`` together, as written; else they are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.staging import staged

#: Letters, digits and bytes of other scripts are words' bytes; all other ASCII separates words.
SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[128:] = False
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = False
#: Bytes of text in a segment, windows in a block, and bytes of blocks that are broadcast, at most.
SEGMENT, BLOCK, BROADCAST_BYTES = 4 << 20, 10_000, 32 << 20
#: Candidate places that are intersected at a time.
CANDIDATES = 1 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word's term, terms, first word of each row) of lower-cased texts."""
    data, offsets = bw.buffer(column)
    data = bw.LOWER[data]
    start, end, first = bw.words(data, offsets, SEPARATOR)
    code, terms = bw.codes(data, start, end)
    return code, terms, first


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of these numbers, 7 bits each and the lowest first, and how many bytes each takes); the last byte of a number has its top bit set."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[end[has] - size[has] + i] = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
    out[end - 1] |= 128
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of ``packed`` bytes."""
    last = np.flatnonzero(data & 128)
    if not len(last):
        return np.zeros(0, np.int64)
    begin = np.append(0, last[:-1] + 1)
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begin)


def _segment(batch: pa.RecordBatch, gap: int) -> dict:
    """A segment of the rows of ``batch``: terms in order, the places of each, and where each document begins."""
    code, terms, first = _words(batch.column("text"))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(code)) + gap * row
    order = np.argsort(code, kind="stable")
    count = np.bincount(code, minlength=len(terms))
    step = np.diff(place[order], prepend=0)
    begin = np.cumsum(count) - count
    step[begin] = place[order][begin]
    data, size = packed(step)
    size = np.add.reduceat(size, begin) if len(begin) else size
    return {
        "ids": batch.column("id"), "first": (first[:-1] + gap * np.arange(len(first) - 1)).astype(np.int64), "n_words": np.diff(first).astype(np.int64),
        "terms": b" ".join(terms.to_pylist()), "counts": count.astype("<u4").tobytes(), "sizes": size.astype("<u4").tobytes(), "places": data.tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, gap: int = 64) -> DataFrame:
    """The positional index of ``docs`` as a written table, a row for each segment; ``gap`` is the longest window with its slack, at least.

    Null texts have no words but stand in their segment. A text longer than
    ``segment`` bytes is a segment of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text", segment):
            s = _segment(batch, gap)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [listed(s["ids"]), listed(pa.array(s["first"])), listed(pa.array(s["n_words"])), *[pa.array([s[c]], pa.binary()) for c in ("terms", "counts", "sizes", "places")]],
                ["ids", "first", "n_words", "terms", "counts", "sizes", "places"],
            )

    schema = f"ids array<{kind}>, first array<long>, n_words array<long>, terms binary, counts binary, sizes binary, places binary"
    made = rows.mapInArrow(build, schema).select(F.monotonically_increasing_id().alias("segment"), "*")
    # small row groups, so that a reader never holds more than a few segments
    return staged(made, "index", {"parquet.block.size": str(2 * segment)})


def benchmark_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, words, items), written: the distinct windows of the benchmark, numbered, their words joined by one space, and the ids of the items that hold each, as sorted strings.

    A text of fewer words than ``window``, but not none, is one window. Items
    that are null, empty or wordless have none; a null id counts as no item,
    but its windows stay.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            data, offsets = bw.buffer(batch.column("text"))
            data = bw.LOWER[data]
            start, end, first = bw.words(data, offsets, SEPARATOR)
            text, s, e = bw.normalised(data, start, end)
            n = np.diff(first)
            k = np.where(n < window, np.minimum(n, 1), n - window + 1)
            row = np.repeat(np.arange(len(n)), k)
            at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            last = at + np.minimum(n, window)[row] - 1
            words = [text[i:j].decode("utf-8") for i, j in zip(s[at].tolist(), e[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column("item").take(pa.array(row))], ["words", "item"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    each = items.mapInArrow(cut, "words string, item string").groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return staged(each.select(F.monotonically_increasing_id().alias("window"), "words", "items"), "windows")


def _lists(s: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of places of these terms one after the other, and where each begins (one more at the end)."""
    end = np.cumsum(s["sizes"].astype(np.int64))
    count = s["counts"][terms].astype(np.int64)
    index, _ = bw.spans(end[terms] - s["sizes"][terms], end[terms])
    total = np.cumsum(unpacked(s["places"][index]))
    begin = np.cumsum(count) - count
    before = np.where(begin > 0, total[begin - 1], 0)
    return total - np.repeat(before, count), np.append(begin, len(total))


class _Lists:
    """The lists of places that the windows ``wanted`` need in one segment; each window's terms stand rarest first."""

    def __init__(self, s: dict, wanted: list[np.ndarray], slack: int) -> None:
        self.slack, self.size = slack, np.array([len(w) for w in wanted])
        flat = np.concatenate(wanted)
        self.head = np.cumsum(self.size) - self.size
        window = np.repeat(np.arange(len(self.size)), self.size)
        offset = np.arange(len(flat)) - np.repeat(self.head, self.size)
        order = np.lexsort((offset, s["counts"][flat], window))
        self.offset = offset[order]
        terms, self.own = np.unique(flat[order], return_inverse=True)
        self.places, self.begin = _lists(s, terms)
        # all lists in one sorted array: a term's places, raised by the term's number
        self.span = int(self.places.max()) + 2 * (int(self.size.max()) + slack + 1)
        self.raised = self.places + np.repeat(np.arange(len(terms)), np.diff(self.begin)) * self.span

    def holds(self, k: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
        """Does the list of the ``k``-th term, moved by its offset, hold a place within ``slack`` of ``at``?"""
        want = self.own[k] * self.span + at + self.offset[k]
        found = np.searchsorted(self.raised, want - slack)
        return (found < len(self.raised)) & (self.raised[np.minimum(found, len(self.raised) - 1)] <= want + slack)

    def met(self, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first place, place of the rarest term) of all alignments that put the windows' rarest term within the slack of one of these places."""
        shift = np.arange(-self.slack, self.slack + 1)
        w, anchor = np.repeat(window, len(shift)), np.repeat(place, len(shift))
        at = anchor - self.offset[self.head[w]] + np.tile(shift, len(window))
        for i in range(1, int(self.size[window].max(initial=0))):
            more = np.flatnonzero(self.size[w] > i)
            stay = np.ones(len(w), bool)
            stay[more] = self.holds(self.head[w[more]] + i, at[more], self.slack)
            w, at, anchor = w[stay], at[stay], anchor[stay]
        return w, at, anchor

    def exact(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which alignments have every word in its own place?"""
        out = np.ones(len(w), bool)
        for i in range(int(self.size[w].max(initial=0)) if self.slack else 0):
            more = np.flatnonzero(out & (self.size[w] > i))
            out[more] = self.holds(self.head[w[more]] + i, at[more], 0)
        return out


def search(s: dict, wanted: list[np.ndarray], slack: int = 0, candidates: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, first place, end, a place of its document, is it exact?) of all matches in a segment.

    ``wanted`` holds, for each window, the numbers of its terms there. Every
    exact phrase is a match. Alignments next to each other, none of them
    exact, are one proximity match, which runs from the first's begin to the
    last's end.
    """
    if not wanted:
        return
    own = _Lists(s, wanted, slack)
    rare = own.own[own.head]
    count = np.diff(own.begin)[rare]
    low = 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(np.cumsum(count[low:]), candidates, side="right")) + low)
        index, _ = bw.spans(own.begin[rare[low:high]], own.begin[rare[low:high] + 1])
        window, found = np.repeat(np.arange(low, high), count[low:high]), []
        for part in range(0, len(index), candidates):
            found.append(own.met(window[part : part + candidates], own.places[index[part : part + candidates]]))
        w, at, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        low = high
        order = np.lexsort((anchor, at, w))
        w, at, anchor = w[order], at[order], anchor[order]
        new = np.append(True, (w[1:] != w[:-1]) | (at[1:] != at[:-1]))[: len(w)]
        w, at, anchor = w[new], at[new], anchor[new]
        exact = own.exact(w, at)
        yield w[exact], at[exact], at[exact] + own.size[w[exact]], anchor[exact], exact[exact]
        if slack and len(w):
            run = np.cumsum(np.append(0, (w[1:] != w[:-1]) | (at[1:] != at[:-1] + 1)))
            begin = np.flatnonzero(np.diff(run, prepend=-1))
            end = np.append(begin[1:], len(w)) - 1
            near = ~np.logical_or.reduceat(exact, begin)
            begin, end = begin[near], end[near]
            yield w[begin], at[begin], at[end] + own.size[w[begin]], anchor[begin], np.zeros(len(begin), bool)


def phrase_matches(index: DataFrame, windows: DataFrame, slack: int = 0, block: int = BLOCK, most: int = BROADCAST_BYTES) -> DataFrame:
    """(segment, doc, start, end, exact, window): each match of a window in the documents of ``index``.

    ``doc`` is the document's number in its segment; start and end count its
    words from 0, end exclusive. The index needs a gap of more than twice the
    slack and the longest window.
    """
    spark = index.sparkSession
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words") + 24), F.lit(0))).first()
    blocks = max(1, -(-n // block))
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int"))
    packs = staged(dealt.groupBy("block").agg(F.collect_list(F.struct("window", "words")).alias("windows")), "blocks")
    each = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # four bytes a character at most
    joined = each.join(F.broadcast(packs) if 4 * size <= most else packs.hint("merge"), "block")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("block")[0].as_py() != number:
                    number, known = row.column("block")[0].as_py(), _block(row.column("windows").flatten())
                yield from _found(row, *known, slack)

    return joined.select("segment", "block", "first", "n_words", "terms", "counts", "sizes", "places", "windows").mapInArrow(find, "segment long, doc int, start int, end int, exact boolean, window long")


def _block(windows: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, number of each window word's term, first word of each window and one more, number of each window)."""
    words = pc.split_pattern(windows.field("words"), " ")
    told = words.flatten().dictionary_encode()
    first = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return told.dictionary.cast(pa.binary()), told.indices.to_numpy(zero_copy_only=False), first, windows.field("window").to_numpy()


def _found(row: pa.RecordBatch, terms: pa.Array, code: np.ndarray, head: np.ndarray, number: np.ndarray, slack: int) -> Iterator[pa.RecordBatch]:
    """The matches of a block's windows in the segment ``row``."""
    blob = lambda c, kind: np.frombuffer(row.column(c)[0].as_buffer(), kind)
    s = {"counts": blob("counts", "<u4"), "sizes": blob("sizes", "<u4"), "places": blob("places", np.uint8)}
    if not len(s["counts"]):
        return
    data = blob("terms", np.uint8)
    space = np.flatnonzero(data == 32)
    edge = np.concatenate([[0], space - np.arange(len(space)), [len(data) - len(space)]]).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data[data != 32]))])
    term = pc.fill_null(pc.index_in(terms, own), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    alive = np.flatnonzero(np.minimum.reduceat(term, head[:-1]) >= 0)
    wanted = [term[head[i] : head[i + 1]] for i in alive.tolist()]
    first, n_words = (row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("first", "n_words"))
    for w, start, end, anchor, exact in search(s, wanted, slack):
        # empty documents begin where the next one does, less the gap
        doc = np.searchsorted(first, anchor, side="right") - 1
        start, end = np.maximum(start - first[doc], 0), np.minimum(end - first[doc], n_words[doc])
        segment = np.full(len(w), row.column("segment")[0].as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([*map(pa.array, (segment, doc.astype(np.int32), start.astype(np.int32), end.astype(np.int32), exact, number[alive[w]]))], ["segment", "doc", "start", "end", "exact", "window"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, most: int = BROADCAST_BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, spans, items, near and contaminated.

    ``spans`` are the merged (start, end) word ranges that windows of the
    benchmark cover exactly, n_hit the words in them, ``items`` the ids, as
    sorted strings, of the items with such a window, ``near`` the ranges of
    proximity matches. Null, empty and wordless texts have no words and no
    matches; very long texts are searched whole; repeated rows and ids each
    return; repeated items count once, null item ids not at all, though their
    windows do; empty tables give no rows or no matches. Other columns are not
    read.
    """
    index = build_index(docs, id_col, text_col, segment, 2 * (window + slack) + 2)
    windows = benchmark_windows(benchmark, window, item_col, item_text)
    found = staged(phrase_matches(index, windows, slack, block, most), "matches")
    pair = F.struct("start", "end")
    spans = found.groupBy("segment", "doc").agg(F.array_sort(F.collect_set(F.when(F.col("exact"), pair))).alias("each"), F.array_sort(F.collect_set(F.when(~F.col("exact"), pair))).alias("near"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def merge(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(x["start"] <= last["end"], joined).otherwise(F.concat(acc, F.array(x)))

    spans = spans.select("segment", "doc", F.aggregate("each", none, merge).alias("spans"), "near")
    held = found.where("exact").select("segment", "doc", "window").distinct().join(windows.select("window", "items").hint("merge"), "window")
    items = held.groupBy("segment", "doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = spans.join(items.hint("merge"), ["segment", "doc"], "left")
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "d")).select("segment", "doc", F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))
    out = rows.join(hits.hint("merge"), ["segment", "doc"], "left").withColumn("spans", F.coalesce("spans", none))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = out.select("id", "n_words", n_hit.alias("n_hit"), "spans", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("near", none).alias("near"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items", "near", (F.col("n_hit") > 0).alias("contaminated"))
