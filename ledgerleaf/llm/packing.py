"""Best-fit packing of tokenised documents into sequences, with swap-based local search.

Only a document longer than a sequence is cut. Pieces are packed by best fit,
largest first, in groups of bounded size; then a local search exchanges pieces
between underfull sequences (move, one for one, two for one) wherever that
raises the sum of squared fills, until sequences empty or nothing helps. The
sequences that stay underfull in all groups are broken up and packed again in
fewer groups, until one group or no gain is left.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import tokens
from ledgerleaf.llm.staging import staged

#: Pieces that one task packs together.
GROUP = 40_000


def document_pieces(docs: DataFrame, size: int, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, row_key, piece, start, length, ids_crc32, and its ids on request.

    row_key tells apart rows that repeat an id (or hold none). A longer
    document's first piece takes the remainder, so that the others are full.
    """
    tokenizer = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, offsets in tokens.encoded(batches, tokenizer):
            n = np.diff(offsets) + 1
            pieces = -(-n // size)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * size
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
            length = np.where(piece == 0, first[row], size)
            full = np.full(len(flat) + len(n), end_id, dtype="<u4")
            full[np.arange(len(flat)) + np.repeat(np.arange(len(n)), np.diff(offsets))] = flat
            at = ((offsets[:-1] + np.arange(len(n)))[row] + start) * 4
            view = memoryview(full.tobytes())
            spans = [(a, b) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [
                batch.column("id").take(pa.array(row)), batch.column("row_key").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length), pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array([bytes(view[a:b]) for a, b in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Bins:
    """Sequences under work: the pieces of each, and which have how much room."""

    def __init__(self, size: int):
        self.size, self.items, self.fill = size, [], []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms = np.zeros(size + 2, np.int64)

    def _enter(self, b: int) -> None:
        room = self.size - self.fill[b]
        self.by_room[room].append(b)
        self.rooms[room] += 1

    def best_fit(self, lengths: np.ndarray) -> None:
        """Place each piece, largest first, where the least room remains."""
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fits = n + int((self.rooms[n:] > 0).argmax())
            if self.rooms[fits]:
                b = self.by_room[fits].pop()
                self.rooms[fits] -= 1
                self.items[b].append(i)
                self.fill[b] += n
            else:
                b = len(self.items)
                self.items.append([i])
                self.fill.append(n)
            if self.fill[b] < self.size:
                self._enter(b)


def local_search(items: list[list[int]], fill: list[int], lengths: np.ndarray, size: int, rounds: int = 4) -> None:
    """Improve underfull sequences in place: each accepted exchange raises the sum of squared fills.

    From the emptiest sequence x, each piece p moves to the fullest sequence
    with room for it, or trades places with one smaller piece, or with two,
    of a fuller sequence, chosen so that the fuller one gains. Emptied
    sequences vanish.
    """
    for _ in range(rounds):
        low = sorted((b for b in range(len(items)) if 0 < fill[b] < size), key=lambda b: fill[b])
        if len(low) < 2:
            return
        gained = False
        taken: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length of a piece: (sequence, piece)
        room = np.zeros(size + 1, np.int64)
        at_room: dict[int, set[int]] = defaultdict(set)
        for b in low:
            at_room[size - fill[b]].add(b)
            room[size - fill[b]] += 1
            for p in items[b]:
                taken[int(lengths[p])].append((b, p))

        def change(b: int, out: list[int], back: list[int]) -> None:
            at_room[size - fill[b]].discard(b)
            room[size - fill[b]] -= 1
            for p in out:
                items[b].remove(p)
            items[b] += back
            fill[b] += int(sum(lengths[p] for p in back)) - int(sum(lengths[p] for p in out))
            at_room[size - fill[b]].add(b)
            room[size - fill[b]] += 1
            for p in back:
                taken[int(lengths[p])].append((b, p))

        def find(length: int, not_in: int, fuller: int) -> tuple[int, int] | None:
            """A piece of this length in another sequence that is at least so full."""
            left = taken.get(length, [])
            while left and left[-1][1] not in items[left[-1][0]]:
                left.pop()
            for b, p in reversed(left[-6:]):
                if b != not_in and fill[b] >= fuller and p in items[b]:
                    return b, p
            return None

        for x in low:
            for p in sorted(items[x], key=lambda p: -lengths[p]):
                if p not in items[x]:
                    continue
                n = int(lengths[p])
                fitting = np.flatnonzero(room[n:])
                y = next((b for r in fitting[:3].tolist() for b in at_room[r + n] if b != x and fill[b] >= fill[x]), None)
                if y is not None:  # move
                    change(x, [p], [])
                    change(y, [], [p])
                    gained = True
                    continue
                for r in np.flatnonzero(room)[:12].tolist():  # fullest sequences first
                    if r <= 0 or r >= n:
                        continue
                    # one for one: the piece that leaves is smaller by the room there, so that sequence becomes full
                    got = find(n - r, x, fill[x])
                    if got and size - fill[got[0]] >= r:
                        y, q = got
                        change(x, [p], [q])
                        change(y, [q], [p])
                        gained = True
                        break
                    # two for one: two pieces of one sequence leave for p
                    y = next((b for b in at_room[r] if b != x and len(items[b]) > 1 and fill[b] >= fill[x]), None)
                    if y is not None:
                        two = _pair(items[y], lengths, n - r, n - 1)
                        if two and size - fill[x] + n >= int(lengths[two[0]] + lengths[two[1]]):
                            change(x, [p], list(two))
                            change(y, list(two), [p])
                            gained = True
                            break
        if not gained:
            return


def _pair(items: list[int], lengths: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two pieces whose lengths sum to the smallest value from ``least`` to ``most``."""
    best, out = most + 1, None
    few = items[:12]
    for i, a in enumerate(few):
        for b in few[i + 1 :]:
            if least <= (s := int(lengths[a] + lengths[b])) < best:
                best, out = s, (a, b)
    return out


def pack_lengths(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its sequence (numbered from 0), its offset there and the sequence's fill."""
    bins = Bins(size)
    bins.best_fit(lengths)
    local_search(bins.items, bins.fill, lengths, size)
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    n = 0
    for own in bins.items:
        if own:
            sizes = lengths[own]
            where[own], offset[own], fill[own] = n, np.cumsum(sizes) - sizes, sizes.sum()
            n += 1
    return where, offset, fill


def pack(pieces: DataFrame, size: int, keys: list[str], length_col: str = "length", group: int = GROUP, waste: float = 0.0005) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Groups are dealt by a hash of the keys, which must tell rows apart. After
    a round, sequences filled to over 1 - ``waste`` stay; the rest are packed
    again in groups of the same size, until one group holds them all, hardly a
    sequence got full (over nine tenths of the pieces are left), or 16 rounds
    are over; then all stay as the round packed them. No piece is left out.
    Rows of null or non-positive length are not packed and return nulls; an
    empty table gives none. Ties are broken by the keys' order.
    """
    ok = F.col(length_col).between(1, size)
    todo = staged(pieces.where(ok).select(*keys, F.col(length_col).cast("long").alias("length")), "lengths")
    kinds = ", ".join(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in keys)
    done, level, left = [], 0, todo.count()
    while left:
        groups = max(1, -(-left // group))

        def run(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(["length", *keys], ascending=[False, *[True] * len(keys)], ignore_index=True)
            where, offset, fill = pack_lengths(own["length"].to_numpy(), size)
            return own.assign(sequence=where, offset=offset, fill=fill)  # noqa: B023

        dealt = todo.withColumn("part", F.pmod(F.xxhash64(F.lit(level), *keys), F.lit(groups)).cast("int"))
        packed = staged(dealt.groupBy("part").applyInPandas(run, f"{kinds}, length long, part int, sequence long, offset long, fill long"), f"packed{level}")
        number = (F.lit(level).cast("long") * F.lit(1 << 58)) + F.col("part").cast("long") * F.lit(1 << 32) + F.col("sequence")
        packed = packed.select(*keys, number.alias("sequence_id"), "offset", "fill", "length")
        if groups == 1 or level == 15:
            done.append(packed.select(*keys, "sequence_id", "offset"))
            break
        full = F.col("fill") >= F.lit(size * (1 - waste))
        done.append(packed.where(full).select(*keys, "sequence_id", "offset"))
        todo = packed.where(~full).select(*keys, "length")
        now = todo.count()
        if now > 0.9 * left:  # hardly a sequence got full: another deal would not help
            done[-1] = packed.select(*keys, "sequence_id", "offset")
            break
        left, level = now, level + 1
    if not done:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    placed = done[0]
    for other in done[1:]:
        placed = placed.union(other)
    return pieces.join(placed.hint("merge"), keys, "left")


def pack_documents(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row for each piece, with its ids on request.

    Null and empty texts hold the end id only. Repeated rows are packed each;
    an empty table gives none; columns other than doc_id and text are not read.
    """
    pieces = staged(document_pieces(docs, size, tokenizer, end_id, with_ids), "pieces")
    return pack(pieces, size, ["row_key", "piece"]).select(*[c for c in pieces.columns if c != "row_key"], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pack_documents(..., with_ids=True)``.

    A group is one sequence, so it is bounded by the sequence size.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.array_join(F.transform(own, lambda x: F.hex(x["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))
