"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is cut into m = budget + 2 segments in a ring. If two
fingerprints differ in at most t bits, then some segment starts a chain whose
first l segments together differ in at most l*t/m bits, for every l (the
strong pigeonring principle). With t = 4 and m = 6 the first segment agrees
and the first two differ in at most one bit, so these two make the join key;
the longer chains are checked before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.components import connected_components, forest
from ledgerleaf.llm.near_copies import near_copies
from ledgerleaf.llm.staging import staged

_U = np.uint64
#: A key with more fingerprints than this is dealt out in blocks.
BLOCK = 1024
#: At most so many keys are looked up by broadcast.
MOST_HOT = 100_000


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, ngram: int) -> np.ndarray:
    """The SimHash of each row: a bit is set if it is set in over half of the row's shingle hashes."""
    data = bw.LOWER[data]
    start, end, first = bw.words(data, offsets)
    n = np.diff(first)
    text, start, end = bw.normalised(data, start, end)
    shingles = np.where(n >= ngram, n - ngram + 1, np.minimum(n, 1))
    begin = np.cumsum(shingles) - shingles
    total = int(shingles.sum())
    index = np.arange(total) - np.repeat(begin - first[:-1], shingles)
    until = end[index + np.repeat(np.minimum(n, ngram) - 1, shingles)] if total else end[:0]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[s:e], 42) for s, e in zip(start[index].tolist(), until.tolist(), strict=True)), np.uint64, total)
    out = np.zeros(len(n), np.uint64)
    filled = shingles > 0
    if not total:
        return out
    at, half = begin[filled], shingles[filled].astype(np.uint64)
    for bit in range(32):
        both = np.add.reduceat((h >> _U(bit)) & _U(0x0000000100000001), at)
        out[filled] |= ((both & _U(0xFFFFFFFF)) * _U(2) > half).astype(np.uint64) << _U(bit)
        out[filled] |= ((both >> _U(32)) * _U(2) > half).astype(np.uint64) << _U(bit + 32)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4) -> DataFrame:
    """(id, fp) per row, fp being the fingerprint's bits as a long. Null and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            fp = text_fingerprints(*bw.buffer(batch.column("text")), ngram)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class Ring:
    """Segments of 64 bits in a ring and the budgets of their chains."""

    def __init__(self, bits: int, segments: int):
        self.m, self.bits = segments, bits
        cut = [64 * i // segments for i in range(segments + 1)]
        self.low, self.width = cut[:-1], [b - a for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.mask = [_U(((1 << w) - 1) << a) for a, w in zip(self.low, self.width, strict=True)]
        self.shift = max(self.width)

    def chain(self, i: int, length: int) -> np.uint64:
        out = _U(0)
        for j in range(length):
            out |= self.mask[(i + j) % self.m]
        return out

    def keys(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, fp, member): the keys of a fingerprint's own chains, and those one bit off in the second segment.

        Of two fingerprints that differ in one bit of a segment one has even parity there; it alone makes the second kind.
        """
        out = []
        for i in range(self.m):
            j = (i + 1) % self.m
            a = (fp & self.mask[i]) >> _U(self.low[i])
            b = (fp & self.mask[j]) >> _U(self.low[j])
            key = (_U(i) << _U(2 * self.shift)) | (a << _U(self.shift)) | b
            out.append((key, fp, np.ones(len(fp), bool)))
            even = np.bitwise_count(b) % 2 == 0
            for bit in range(self.width[j]):
                out.append((key[even] ^ _U(1 << bit), fp[even], np.zeros(int(even.sum()), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _near(ring: Ring, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of a key keep every chain's budget, the whole ring last."""
    x = a ^ b
    first = (key >> _U(2 * ring.shift)).astype(np.int64)
    ok = np.ones(len(x), bool)
    for length in range(2, ring.m + 1):
        chain = np.array([ring.chain(i, length) for i in range(ring.m)], np.uint64)
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(x[at] & chain[first[at]]) <= length * ring.bits // ring.m
    return ok


def _run_links(ring: Ring, key: np.ndarray, group: np.ndarray, fp: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal (key, block), which lie together with members first; a forest of them."""
    edge = np.flatnonzero(np.diff(group)) + 1
    last = np.repeat(np.append(edge, len(group)), np.diff(np.concatenate([[0], edge, [len(group)]])))
    left = np.flatnonzero(member)
    a, b, d = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 1
    while True:
        left = left[left + d < last[left]]
        if not len(left):
            break
        ok = left[_near(ring, key[left], fp[left], fp[left + d])]
        a, b = np.concatenate([a, fp[ok]]), np.concatenate([b, fp[ok + d]])
        if len(a) > 1_000_000:
            a, b = forest(a, b)
        d += 1
    return forest(a, b)


def near_links(distinct: DataFrame, bits: int = 4, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs with at most ``bits`` differing bits do.

    ``distinct`` has one row per fingerprint in column fp. Pairs are compared
    inside tasks and never emitted; a task returns a spanning forest of its
    links. Keys with over ``block`` fingerprints are split into blocks that
    are compared with each other in separate tasks.
    """
    ring = Ring(bits, segments or bits + 2)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, member = ring.keys(batch.column("fp").to_numpy().view(np.uint64))
            for at in range(0, len(key), 100_000):
                to = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[to].view(np.int64)), pa.array(fp[to].view(np.int64)), pa.array(member[to])], ["key", "fp", "member"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expand(batches):
            yield batch.filter(batch.column("member")).select(["key"])

    own = distinct.select("fp").mapInArrow(members, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    n = distinct.count()
    hot = staged(own.where(F.col("n") > max(block, ring.m * n // MOST_HOT)).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    rows = distinct.select("fp").mapInArrow(expand, "key long, fp long, member boolean")
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # A member is compared with its own block as a member and with later blocks as a guest; a one-bit-off row is a guest of all.
    rows = rows.select("key", "fp", F.when(F.col("member"), mine).otherwise(F.lit(-1)).alias("home"), "blocks")
    rows = rows.select("key", "fp", "home", F.explode(F.sequence(F.greatest("home", F.lit(0)), F.col("blocks") - 1)).alias("block"))
    rows = rows.select("key", "block", "fp", (F.col("home") != F.col("block")).alias("guest"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        held: list[list[np.ndarray]] = []
        size = 0

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept, held, size
            parts = ([kept] if kept is not None else []) + held
            if not parts:
                return
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            key, blk, fp, guest = cols
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(blk) != 0)) + 1
            cut = len(key) if final else (int(change[-1]) if len(change) else 0)
            kept, held, size = [c[cut:] for c in cols], [], len(key) - cut
            if cut:
                group = np.zeros(cut, np.int64)
                group[change[change < cut]] = 1
                a, b = _run_links(ring, key[:cut].view(np.uint64), np.cumsum(group), fp[:cut].view(np.uint64), ~guest[:cut])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)])
            size += batch.num_rows
            if size >= 400_000:
                yield from work(False)
        yield from work(True)

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "guest", "fp")
    return dealt.mapInArrow(pairs, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, bits: int = 4, segments: int | None = None, similarity: float | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits) and component_id.

    Texts are lower-cased (A-Z) and cut into words; fingerprints that differ
    in at most ``bits`` bits are linked, and component_id is the smallest id
    reachable. Null, empty and wordless texts have fingerprint zero and link
    like any other; ``segments`` (more than ``bits``) trades longer keys for
    fewer candidates; repeated rows each return; rows with a null id keep it and
    never name a component unless all of it is null; an empty table gives
    none. Columns other than the two named are not used.

    With ``similarity``, rows are linked by the Jaccard similarity of their
    sets of shingles instead, longer fingerprints finding the candidates
    (near_copies.py); ids must then be unique longs, and no fingerprint returns.
    """
    if similarity is not None:
        return near_copies(docs, id_col, text_col, ngram, similarity)
    fps = staged(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = staged(connected_components(near_links(classes, bits, segments=segments), "a", "b"), "roots")
    lowest = staged(roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    linked = roots.join(lowest.hint("merge"), "root").select(F.col("node").alias("fp"), "component_id")
    named = staged(classes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    return fps.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
