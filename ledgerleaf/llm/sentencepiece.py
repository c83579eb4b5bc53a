"""SentencePiece BPE encoding and decoding by suffix-array matching.

White space is part of the text (a space stands for the model's mark), and
merges never cross from a word into the space before the next, so a batch is
cut into units of spaces plus word, and every distinct unit is encoded once a
worker. The new units of a batch are laid end to end and indexed by a suffix
array; each piece of the model is found by binary search, which gives all its
occurrences as a range. The occurrences are edges from start to end; sorted by
position they are relaxed from left to right. The relaxation keeps, for each
position, the last piece of the encoding of the unit up to there: an edge may
follow the piece before it if merging the two pieces' text from scratch gives
the same two pieces, which decides BPE segmentation pair by pair. Characters
that no piece covers are edges of their own and become byte pieces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw

MARK = "▁"
#: Suffixes are ordered, and pieces compared, seven bytes at a time: a byte takes nine bits, so that an end sorts first.
PACK, BITS = 7, 9
NONE, BEGIN, UNKNOWN = -3, -2, -1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions of ``text`` (values from 0, where 0 ends a unit) in the order of their first ``longest`` values, by doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(PACK, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(PACK):
        key = (key << np.uint64(BITS)) | padded[i : i + n]
    order, width = np.argsort(key, kind="stable"), PACK
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
    while width < longest and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
        width *= 2
    return order


class Model:
    """The pieces of a BPE model with byte fallback, and a cache of encoded units by their 64-bit hash."""

    #: Above so many cached units the cache starts anew, which bounds a worker's memory.
    MOST = 1_500_000

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = np.zeros(256, np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[1:-1], 16)] = i
        self.surface = {i: sp.id_to_piece(i).replace(MARK, " ") for i in usual}
        self.by_text = {s: i for i, s in self.surface.items()}
        order = sorted(usual, key=lambda i: -sp.get_score(i))
        rank, last = {}, None
        for at, i in enumerate(order):
            last = at if at == 0 or sp.get_score(i) != sp.get_score(order[at - 1]) else last
            rank[i] = last
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        usable = []
        for i, s in self.surface.items():
            if len(s) == 1:
                usable.append(i)
                continue
            parts = self.merge(s, rank, stop=True)
            if len(parts) == 2 and rank[i] is not None:
                self.left[i], self.right[i], self.rank[i] = *(self.by_text[p] for p in parts), rank[i]
                usable.append(i)
        pairs = [(self.by_text[s[:c]] * size + self.by_text[s[c:]], rank[i]) for i, s in self.surface.items() for c in range(1, len(s)) if s[:c] in self.by_text and s[c:] in self.by_text]
        pairs.sort()
        self.size = size
        self.pair_key, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        encoded = sorted((self.surface[i].encode(), i) for i in usable)
        self.piece_id = np.array([i for _, i in encoded])
        self.piece_len = np.array([len(b) for b, _ in encoded])
        self.longest = int(self.piece_len.max())
        words = -(-self.longest // PACK)
        raw = np.zeros((len(encoded), words * PACK), np.uint64)
        top = np.full((len(encoded), words * PACK), (1 << BITS) - 1, np.uint64)
        for row, (b, _) in enumerate(encoded):
            raw[row, : len(b)] = top[row, : len(b)] = np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)
        pack = lambda m: np.stack([sum(m[:, w * PACK + j] << np.uint64(BITS * (PACK - 1 - j)) for j in range(PACK)) for w in range(words)], axis=1)
        self.least, self.most = pack(raw), pack(top)
        self.alone = np.ones(256, bool)  # bytes that no piece holds cut units
        for b, _ in encoded:
            self.alone[list(b)] = False
        self.alone[128:] = False
        self.ids_of: dict[int, bytes] = {int(self.bytes[b]): bytes([b]) for b in range(256)} | {i: s.encode() for i, s in self.surface.items()}
        self.clear()

    def merge(self, text: str, rank: dict[int, int], stop: bool = False) -> list[str]:
        """BPE of a short text from scratch: the best pair, leftmost first, is merged until none is left, or with ``stop`` until two parts are."""
        parts = list(text)
        while len(parts) > (2 if stop else 1):
            found = [(rank[self.by_text[a + b]], at) for at, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in self.by_text]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def clear(self) -> None:
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a? The last merges are undone, latest first; between them no merge across may come earlier."""
        ok = (a < 0) | (b < 0)
        live = np.flatnonzero(~ok)
        a, b = a[live], b[live]
        limit = np.full(len(live), np.inf)
        while len(live):
            place = np.minimum(np.searchsorted(self.pair_key, key := a * self.size + b), len(self.pair_key) - 1)
            crossing = np.where(self.pair_key[place] == key, self.pair_rank[place], np.inf)
            ra, rb = self.rank[a], self.rank[b]
            fine = crossing >= limit
            single = (ra < 0) & (rb < 0)
            ok[live[fine & single]] = True
            go = fine & ~single
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 0.5)[go]
            a, b = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go]
            live = live[go]
        return ok

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row of the piece) of every occurrence of every piece."""
        order = suffix_array(text, self.longest)
        n, words = len(text), self.least.shape[1]
        padded = np.concatenate([text.astype(np.uint64), np.zeros(PACK * (words + 1), np.uint64)])
        packed = np.zeros(len(padded) - PACK, np.uint64)
        for i in range(PACK):
            packed = (packed << np.uint64(BITS)) | padded[i : i + len(packed)]

        def bound(keys: np.ndarray, above: bool) -> np.ndarray:
            """How many suffixes sort before each key (or, with ``above``, not after it)."""
            lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), n)
            while (open_ := lo < hi).any():
                at = np.flatnonzero(open_)
                mid = (lo[at] + hi[at]) // 2
                start = order[mid]
                less, tied = np.zeros(len(at), bool), np.arange(len(at))
                for w in range(words):
                    got, want = packed[start[tied] + w * PACK], keys[at[tied], w]
                    less[tied] = got < want
                    tied = tied[got == want]
                    if not len(tied):
                        break
                less[tied] = above
                lo[at[less]], hi[at[~less]] = mid[less] + 1, mid[~less]
            return lo

        lo, hi = bound(self.least, False), bound(self.most, True)
        found = np.flatnonzero(hi > lo)
        index, _ = bw.spans(lo[found], hi[found])
        return order[index], np.repeat(found, (hi - lo)[found])

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units one after the other, and the number of each."""
        size = np.array([len(u) for u in units])
        raw = np.frombuffer(b"\x00".join(units) + b"\x00", np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        text = raw.astype(np.uint16) + 1
        text[begin + size] = 0
        unit = np.repeat(np.arange(len(units)), size + 1)
        start, row = self.occurrences(text)
        piece, end = self.piece_id[row], start + self.piece_len[row]
        # characters without a piece
        lead = np.flatnonzero(((raw & 0xC0) != 0x80) & (text > 0))
        char_end = np.append(lead[1:], len(raw))
        char_end = np.minimum(char_end, (begin + size)[unit[lead]])
        alone = np.zeros(len(raw) + 1, bool)
        alone[start[end - start == char_end[np.minimum(np.searchsorted(lead, start), len(lead) - 1)] - start]] = True
        lone = ~alone[lead]
        start, end = np.concatenate([start, lead[lone]]), np.concatenate([end, char_end[lone]])
        piece = np.concatenate([piece, np.full(int(lone.sum()), UNKNOWN)])
        offset = start - begin[unit[start]]
        order = np.argsort(offset, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        cut = np.searchsorted(offset[order], np.arange(int(offset.max()) + 2)) if len(offset) else np.zeros(1, np.int64)
        last, back = np.full(len(raw) + 1, NONE), np.zeros(len(raw) + 1, np.int64)
        last[begin] = BEGIN
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            live = before != NONE
            s, e, p, before = s[live], e[live], p[live], before[live]
            pair, place = np.unique((before + 3) * (self.size + 3) + p + 3, return_inverse=True)
            good = self.follows(pair // (self.size + 3) - 3, pair % (self.size + 3) - 3)[place]
            last[e[good]], back[e[good]] = p[good], s[good]
        at, who = begin + size, np.arange(len(units))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            go = at > begin[who]
            at, who = at[go], who[go]
            got.append((back[at], last[at], at, who))
            at = back[at]
        s, p, e, _ = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(s, kind="stable")
        s, p, e = s[order], p[order], e[order]
        times = np.where(p == UNKNOWN, e - s, 1)
        index, _ = bw.spans(s, s + times)
        ids = np.where(np.repeat(p == UNKNOWN, times), self.bytes[raw[index]], np.repeat(p, times))
        return ids.astype(np.int32), np.bincount(unit[index], minlength=len(units))

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        if len(self.hashes) > self.MOST:
            self.clear()
        ids, count = self.encode_units(units)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(count) - count
        self.used += len(ids)
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes, self.at, self.count = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]

    def _unknown(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(distinct), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] != distinct

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and the row offsets among them. Null and empty texts have none."""
        data, offsets = bw.buffer(column)
        if MARK.encode() in data.tobytes():  # the mark itself reads as a space
            return self.encode(pa.array([(x or "").replace(MARK, " ") for x in column.to_pylist()], pa.large_string()))
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        lead = np.zeros(len(column) + 1, np.int64)  # a space goes before every text
        lead[filled + 1] = 1
        offsets = offsets + np.cumsum(lead)
        text = np.full(int(offsets[-1]), 0x20, np.uint8)
        put = np.ones(len(text), bool)
        put[offsets[:-1][filled]] = False
        text[put] = data
        first = np.zeros(len(text), bool)
        first[1:] = (text[1:] == 0x20) & (text[:-1] != 0x20)
        cut = self.alone[text]
        first |= cut
        first[1:] |= cut[:-1]
        first[offsets[:-1][filled]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(text))
        hashes = bw.hash_spans(text, start, end)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        whole = text.tobytes()
        for _ in range(2):  # a second time if the cache was cleared
            if (new := self._unknown(distinct)).any():
                self._learn(distinct[new], [whole[s:e] for s, e in zip(start[index[new]].tolist(), end[index[new]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, distinct)[inverse]
        begin, count = self.at[place], self.count[place]
        which, _ = bw.spans(begin, begin + count)
        total = np.concatenate([[0], np.cumsum(count)])
        return self.pool[which], total[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one row's ids; bytes that form no character become the replacement character."""
        text = b"".join([self.ids_of.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model a Python worker and file."""
    return Model(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row. Null and empty texts have no ids; repeated rows each return; an empty table gives none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model(path)
        for batch in bw.slices(batches, "text", 4 << 20):
            ids, offsets = use.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` with the ids' text in place of the ids. Null ids give an empty text; ids outside the model are left out."""
    path = path or default_path()
    rest = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [use.decode(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32)) for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(texts, pa.string())], [*rest, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids_col)
    return encoded.select(*rest, ids_col).mapInArrow(run, f"{kinds}, text string")


def piece_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and round_trip.

    Ids are decoded again in the same task; round_trip says whether that gives
    the text (a null text counts as empty, a mark in the text as a space).
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model(path)
        for batch in bw.slices(batches, "text", 4 << 20):
            ids, offsets = use.encode(batch.column("text"))
            parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            texts = [use.decode(p) for p in parts]
            same = [t == (x or "").replace(MARK, " ") for t, x in zip(texts, batch.column("text").to_pylist(), strict=True)]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], [id_col, "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
