"""Byte-level BPE ids of whole texts, by the tokenizers library, with every distinct word encoded once a worker.

The pre-tokenizer never joins what stands before a run of white space with the
run and what follows it, nor an ASCII letter or digit with a punctuation mark
other than an apostrophe, so such chunks can be encoded on their own. Texts
that hold an added token's string or white space outside ASCII go to the
library whole, as there this does not hold.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from ledgerleaf.llm import bytewords as bw

#: Space that only Unicode knows, as a regular-expression class.
ODD_SPACE = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|$%&*#()[]{}<>=+-_/\\\"@^~`")] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_width(path: str, *others: int) -> int:
    """Bytes of an unsigned integer that holds every id of the tokenizer and the ``others``."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, *others) < 1 << 16 else 4


class Encoder:
    """Encodes batches of texts; keeps the ids of all chunks seen so far, by their 64-bit hash."""

    #: Above so many cached chunks the cache starts anew, which bounds a worker's memory.
    MOST = 1_500_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.whole = re.compile("|".join([f"[{ODD_SPACE}]", *map(re.escape, added)]))
        #: Byte strings of which one is in every text that ``whole`` finds; cheap to look for.
        self.hints = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf", *(x.encode() for x in added)]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.hashes) > self.MOST:
            self.clear()
        parts: list[list[int]] = []
        for i in range(0, len(chunks), 20_000):
            texts = [c.decode("utf-8") for c in chunks[i : i + 20_000]]
            parts += [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(size) - size
        self.used += len(ids)
        order = np.argsort(merged := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.at, self.size = merged[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and the row offsets among them; null counts as empty."""
        data, offsets = bw.buffer(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        text = data.tobytes()
        if any(x in text for x in self.hints) and self.whole.search(text.decode("utf-8")):
            parts = [self._rows(text, data, offsets, i, i + 1) for i in range(len(column))]
            return np.concatenate([p[0] for p in parts]), np.cumsum([0, *(len(p[0]) for p in parts)])
        return self._rows(text, data, offsets, 0, len(column))

    def _rows(self, text: bytes, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = int(offsets[lo]), int(offsets[hi])
        if a == b:
            return np.zeros(0, np.uint32), np.zeros(hi - lo + 1, np.int64)
        if hi - lo == 1 and any(x in text for x in self.hints) and self.whole.search(whole := text[a:b].decode("utf-8")):
            ids = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
            return ids, np.array([0, len(ids)])
        data, offsets = data[a:b], offsets[lo : hi + 1] - a
        space = bw.SEPARATOR[data]
        first = np.zeros(len(data), bool)
        first[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _WORD[data[:-1]])
        first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))
        hashes = bw.hash_spans(data, start, end)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._unknown(distinct)
        if new.any():
            self._learn(distinct[new], [text[a + s : a + e] for s, e in zip(start[index[new]].tolist(), end[index[new]].tolist(), strict=True)])
            if (again := self._unknown(distinct)).any():  # the cache was cleared
                self._learn(distinct[again], [text[a + s : a + e] for s, e in zip(start[index[again]].tolist(), end[index[again]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, distinct)[inverse]
        begin, size = self.at[place], self.size[place]
        which, _ = bw.spans(begin, begin + size)
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[which], total[np.searchsorted(start, offsets)]

    def _unknown(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(distinct), bool)
        place = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
        return self.hashes[place] != distinct


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker and tokenizer file."""
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their ids and row offsets."""
    use = encoder(path)
    for batch in bw.slices(batches, column, 4 << 20):
        yield batch, *use.encode(batch.column(column))
