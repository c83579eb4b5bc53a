"""SimHash near-dedup decided by the similarity of shingle sets: pigeonring candidates, exact Jaccard.

A row's set of shingle hashes gets a fingerprint of ``BITS`` bits, cut into a
ring of ``SEGMENTS`` segments of ``WIDTH`` bits. Two sets of Jaccard similarity
s differ in a share of acos(2s / (1 + s)) / pi of the bits, 0.15 at 0.8, so
their differences leave short chains of the ring untouched. A key is a chain of
two consecutive segments without a difference, which keeps every proportional
budget. In this model a pair at 0.80 has a key in common with probability
0.985, at 0.85 0.999. Rows that share a key become candidates if the first
``CHECKED`` bits differ in ``BUDGET`` at most, and a link is made only if the
sets themselves (of 64-bit hashes) reach the threshold. A key with too many
rows for one task skips the check of bits: its rows all meet.

Rows with the same set are one class. Classes that candidates connect are
compared in one place: their texts meet in tasks. A group with too many
members for a task is dealt into blocks. Each block first meets the group's
least member, which is enough for copies of one text; only if that leaves the
group in parts are blocks of like sizes compared two at a time, unless both
are of the largest part. What a task holds is bounded, however large the
group. Pairs are never emitted: a task returns a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.components import connected_components, forest
from ledgerleaf.llm.staging import drop, free_shuffles, scope, settled, staged

_U = np.uint64
#: Bits of a fingerprint and of a segment, and the segments.
BITS, WIDTH, SEGMENTS = 1280, 10, 128
#: Sets of fewer than ``SMALL`` shingles differ in more bits than the model says; they also use the rings of every second and every third segment.
STRIDES, SMALL = (1, 2, 3), 64
#: Bits that candidates are checked by, a word and the rest, which shares a word with the key; differences among them, at most: over three standard
#: deviations more than a similarity of 0.8 has on average.
REST, BUDGET = 34, 27
CHECKED = 64 + REST
#: Fingerprints of a key that one task compares, about; keys that are looked up by broadcast, at most; share of rows by which large keys are found.
KEY_BLOCK, MOST_HOT, SHARE = 1024, 100_000, 16
#: Members, shingles and bytes of a block of texts, about.
BLOCK, SHINGLES, BYTES = 4096, 1_000_000, 8 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and the index of its first (one more at the end). A shorter text is one shingle."""
    data = bw.LOWER[data]
    start, end, first = bw.words(data, offsets)
    values, n = bw.hash_spans(data, start, end), np.diff(first)
    runs = bw.hash_runs(values, ngram)
    row = np.repeat(np.arange(len(n)), n)[: len(runs)]
    inside = np.arange(len(runs)) + ngram <= first[row + 1]
    row, h = row[inside], runs[inside]
    short = np.flatnonzero((n > 0) & (n < ngram))
    if len(short):
        whole = np.concatenate([bw.hash_runs(values[first[i] : first[i + 1]], int(n[i])) for i in short])
        row, h = np.concatenate([row, short]), np.concatenate([h, bw.mix(whole ^ n[short].astype(np.uint64))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (np.diff(row) != 0) | (np.diff(h) != 0))[: len(h)]
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def fingerprint_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each row that has shingles, as a matrix of ``BITS`` bits: 1 where over half of the row's hashes have it."""
    filled = np.flatnonzero(np.diff(first) > 0)
    begin, size = first[:-1][filled], np.diff(first)[filled]
    parts = -(-size // 255)  # eight counters of eight bits share a word
    joint = np.cumsum(parts) - parts
    at = np.repeat(begin, parts) + (np.arange(int(parts.sum())) - np.repeat(joint, parts)) * 255
    out = np.zeros((len(filled), BITS), bool)
    for word, salt in enumerate(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * bw.MULTIPLIER if len(filled) else []):
        x = bw.mix(h + salt)
        for bit in range(8):
            lanes = np.add.reduceat(x & _U(0x0101010101010101), at).view(np.uint8).reshape(-1, 8)
            out[:, word * 64 + bit * 8 : word * 64 + bit * 8 + 8] = np.add.reduceat(lanes, joint, axis=0, dtype=np.int64) * 2 > size[:, None]
            x >>= _U(1)
    return out


def ring_keys(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all fingerprints, row after row, how many each has, and the two words of each for the check."""
    segments = bits[:, : SEGMENTS * WIDTH].reshape(len(bits), SEGMENTS, WIDTH) @ (1 << np.arange(WIDTH, dtype=np.int32))
    rings = []
    for i, stride in enumerate(STRIDES):
        start = np.arange(SEGMENTS, dtype=np.int32) + SEGMENTS * i
        rings.append((start << 2 * WIDTH | segments << WIDTH | np.roll(segments, -stride, axis=1)).astype(np.int32))
    keys = np.concatenate(rings, axis=1)
    n = np.where(size < SMALL, keys.shape[1], SEGMENTS)
    return keys[np.arange(keys.shape[1]) < n[:, None]], n, np.packbits(np.pad(bits[:, :CHECKED], ((0, 0), (0, 64 - REST))), axis=1, bitorder="little").view(np.uint64)


def candidates(key: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of equal key, which lie together, that differ in at most ``BUDGET`` of the checked bits."""
    edge = np.flatnonzero(np.diff(key)) + 1
    last = np.repeat(np.append(edge, len(key)), np.diff(np.concatenate([[0], edge, [len(key)]])))
    left, d = np.arange(len(key)), 1
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(left := left[left + d < last[left]]):
        ok = left[np.bitwise_count(a[left] ^ a[left + d]) + np.bitwise_count(b[left] ^ b[left + d]) <= BUDGET]
        x, y = np.concatenate([x, node[ok]]), np.concatenate([y, node[ok + d]])
        if len(x) > 1_000_000:
            x, y = forest(x, y)
        d += 1
    return forest(x, y)


def meetings(classes: DataFrame) -> DataFrame:
    """(a, b): links among the nodes of ``classes`` (node, word_a, word_b, keys) that connect every candidate pair."""
    each = classes.select("node", "word_a", "word_b", F.explode(F.col("keys").cast("array<bigint>")).alias("key"))
    n = classes.count()
    # large keys are found by a share of the rows; where the line lies decides where pairs are compared, not whether
    some = each.where(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = staged(some.where(F.col("n") * SHARE > max(KEY_BLOCK, SEGMENTS * len(STRIDES) * n // MOST_HOT)).select("key", F.lit(True).alias("hot")), "hot_keys")
    rows = each.join(F.broadcast(hot), "key", "left")
    large = rows.where("hot").select("key", "node")
    stars = large.groupBy("key").agg(F.min("node").alias("low"))
    stars = large.join(stars.hint("merge"), "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def work(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            key = columns[0]
            cut = len(key) if final else int(np.searchsorted(key, key[-1]))
            held, size = [tuple(c[cut:] for c in columns)], len(key) - cut
            x, y = candidates(*(c[:cut] for c in columns))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            packed, a, node = (c.to_numpy() for c in batch.columns)
            held.append((packed >> REST, a.view(np.uint64), (packed & ((1 << REST) - 1)).view(np.uint64), node))
            size += batch.num_rows
            if size >= 400_000:
                yield from work(False)
        if held:
            yield from work(True)

    packed = rows.where("hot is null").select(F.expr(f"shiftleft(key, {REST}) | word_b").alias("packed"), "word_a", "node")
    dealt = packed.repartition(F.shiftright("packed", REST)).sortWithinPartitions("packed")
    found = staged(dealt.mapInArrow(meet, "a long, b long"), "candidates")
    return found.union(staged(stars, "hot_stars")) if hot.head(1) else found


def similar(h: np.ndarray, first: np.ndarray, threshold: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the rows as all pairs of at least ``threshold`` do; rows of one ``known`` group are connected already.

    Two such rows have at least ``threshold`` of the larger one's shingles in common, so with shingles in one order, rarest
    first, they share one of the first that are left when so many less one are taken off the end. Only rows that do are compared.
    """
    size = np.diff(first)
    told, code, times = np.unique(h, return_inverse=True, return_counts=True)
    rank = np.empty(len(told), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(told))
    flat = np.sort(np.repeat(np.arange(len(size)), size) << 32 | rank[code]) & 0xFFFFFFFF
    mark = np.zeros(len(told), np.int32)
    until = first[:-1] + np.where(size > 0, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)
    until = np.minimum(until, first[1:])
    index, _ = bw.spans(first[:-1], until)
    held = np.bincount(flat[index], minlength=len(told))
    shares = np.bincount(np.repeat(np.arange(len(size)), until - first[:-1]), held[flat[index]] > 1, minlength=len(size)) > 0
    holder = np.repeat(np.arange(len(size)), until - first[:-1])[np.argsort(flat[index], kind="stable")]
    cuts = np.append(0, np.cumsum(held))
    known = np.arange(len(size)) if known is None else np.unique(known, return_inverse=True)[1]
    mates = np.argsort(known, kind="stable")
    cut = np.searchsorted(known[mates], np.arange(len(size) + 1))
    open_, links = size > 0, []
    for seed in range(len(size)):
        if not open_[seed]:
            continue
        todo = [seed]
        open_[seed] = False
        while todo:
            i = todo.pop()
            group = mates[cut[known[i]] : cut[known[i] + 1]]
            for j in group[open_[group]].tolist():
                open_[j] = False
                todo.append(j)
            if not shares[i]:
                continue
            own = flat[first[i] : until[i]]
            rows = holder[bw.spans(cuts[own], cuts[own + 1])[0]]
            rows = np.unique(rows[open_[rows]])
            rows = rows[(size[rows] >= threshold * size[i] - 1e-9) & (size[i] >= threshold * size[rows] - 1e-9)]
            if not len(rows):
                continue
            own = flat[first[i] : first[i + 1]]
            index, begin = bw.spans(first[:-1][rows], first[1:][rows])
            mark[own] = 1
            both = np.add.reduceat(mark[flat[index]], begin)
            mark[own] = 0
            found = rows[both / (size[i] + size[rows] - both) >= threshold]
            open_[found] = False
            links += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    out = np.array(links, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def blocks(block: int, rows: Column | None = None, share: int = 1) -> Column:
    """Into how many blocks a group's members (those with ``rows``) are dealt, each of a ``share`` of what a task holds; no more than members."""
    one = F.lit(1) if rows is None else F.when(rows, 1)
    need = [F.count(one) / block, F.sum(one * F.col("size")) / SHINGLES, F.sum(one * F.col("bytes")) / BYTES]
    return F.least(F.greatest(*[F.ceil(share * x) for x in need]), F.count(one)).cast("int")


def crossing(parts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, meeting, part, one): the members of groups in several parts, dealt so that nodes of different parts that can reach ``threshold`` meet in a task.

    Needs node, meeting, part, size and bytes. A task, (meeting, one), has two blocks of half a task each, one of them not of the
    largest part. Blocks are of one band of sizes and meet those of its band and the next ones, as the smaller of two sets has
    ``threshold`` of the larger one's size at least.
    """
    main = parts.groupBy("meeting", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("meeting").agg(F.max(F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts"))
    own = parts.join(main.where("parts > 1").select("meeting", F.col("most.part").alias("main")).hint("merge"), "meeting")
    band = F.floor(F.log("size") / -math.log(threshold) + 1e-9).cast("int")
    own = own.withColumns({"other": F.col("part") != F.col("main"), "band": band})
    bands = own.groupBy("meeting", "band").agg(blocks(block, ~F.col("other"), 2).alias("mains"), blocks(block, F.col("other"), 2).alias("others"))
    # the blocks of a group are numbered band by band: those of the largest part from low, the others from mid
    order = Window.partitionBy("meeting").orderBy("band")
    bands = bands.withColumn("high", F.sum(F.col("mains") + F.col("others")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    bands = bands.withColumn("mid", F.col("high") - F.col("others")).withColumn("low", F.col("mid") - F.col("mains"))
    bands = bands.withColumn("near", F.collect_list(F.struct("low", "mid", "high")).over(order.rangeBetween(-1, 1)))
    numbers = lambda x, start: F.when(x["high"] > x[start], F.sequence(x[start], x["high"] - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    of = lambda start: F.flatten(F.transform("near", lambda x: numbers(x, start)))
    own = own.join(bands.hint("merge"), ["meeting", "band"])
    deal = lambda start, n: (F.col(start) + F.pmod(F.xxhash64("node"), F.col(n))).cast("int")
    mine = F.when(F.col("other"), deal("mid", "others")).otherwise(deal("low", "mains"))
    each = own.withColumn("mine", mine).withColumn("with", F.explode(F.when(F.col("other"), of("low")).otherwise(of("mid"))))
    one = F.shiftleft(F.least("with", "mine").cast("long"), 31).bitwiseOR(F.greatest("with", "mine").cast("long"))
    return each.select("node", "meeting", "part", one.alias("one"))


def near_copies(docs: DataFrame, id_col: str, text_col: str = "text", ngram: int = 5, threshold: float = 0.8, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: its id, which must be a unique long, and component_id, the smallest id reachable.

    Texts are lower-cased (A-Z) and cut into words; rows whose sets of
    ``ngram``-word shingles have a Jaccard similarity of at least
    ``threshold`` are linked. Null, empty and wordless texts have the empty
    set and link with each other only; an empty table gives none.
    """
    with scope() as own:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return settled(_components(texts, id_col, ngram, threshold, block), "components", own)


def _components(texts: DataFrame, id_col: str, ngram: int, threshold: float, block: int) -> DataFrame:
    """``near_copies`` of (id, text)."""
    spark = texts.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bw.slices(batches, "text"):
            h, first = shingle_sets(*bw.buffer(batch.column("text")), ngram)
            digest = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            filled = np.diff(first) > 0
            keys, n, words = ring_keys(fingerprint_bits(h, first), np.diff(first)[filled])
            both, counts = np.zeros((len(filled), 2), np.uint64), np.zeros(len(filled), np.int64)
            both[filled], counts[filled] = words, n
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(keys))
            size = pa.array(np.diff(bw.buffer(batch.column("text"))[1]))
            columns = [batch.column("id"), pa.array(digest, pa.binary()), pa.array(np.diff(first)), size, *(pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)), keys]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "size", "bytes", "word_a", "word_b", "keys"])

    sketches = staged(texts.mapInArrow(sketch, "id long, digest binary, size long, bytes long, word_a long, word_b long, keys array<int>"), "sketches")
    sample = F.first(F.struct("size", "word_a", "word_b", "keys")).alias("x")  # equal for equal digests
    classes = staged(sketches.groupBy("digest").agg(F.min("id").alias("node"), F.max("bytes").alias("bytes"), sample).select("digest", "node", "bytes", "x.*"), "classes")
    digests = staged(sketches.select("id", "digest"), "digests")
    drop(sketches)
    free_shuffles(spark)
    met = meetings(classes)
    free_shuffles(spark)
    coarse = connected_components(met, "a", "b").join(classes.select("node", "size", "bytes").hint("merge"), "node")
    coarse = staged(coarse.select("node", F.col("root").alias("meeting"), "size", "bytes"), "meetings")
    sized = coarse.groupBy("meeting").agg(blocks(block).alias("blocks"))
    members = staged(coarse.join(sized.hint("merge"), "meeting").select("node", "meeting", "size", "bytes", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")), "members")

    def compare(group: pa.Table) -> pa.Table:
        # a slice of the text at a time, as arrays beside it are many times its size
        sets = [shingle_sets(*bw.buffer(x.column("text")), ngram) for x in bw.slices(iter(group.to_batches()), "text")]
        h, sizes = np.concatenate([x for x, _ in sets]), np.concatenate([np.diff(x) for _, x in sets])
        first, node = np.append(0, np.cumsum(sizes)), group.column("node").to_numpy()
        a, b = similar(h, first, threshold, group.column("part").to_numpy())
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    def links(dealt: DataFrame) -> DataFrame:
        return dealt.select("node", "meeting", "text", "part", "one").groupBy("meeting", "one").applyInArrow(compare, "a long, b long")

    read = members.join(texts.hint("merge"), F.col("node") == F.col("id"))
    first_deal = F.when(F.col("node") == F.col("meeting"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))
    found = staged(links(read.withColumn("part", F.col("node")).withColumn("one", F.explode(first_deal))), "near")
    roots = staged(connected_components(found, "a", "b"), "near_roots")
    parts = members.where("blocks > 1").join(roots.hint("merge"), "node", "left")
    across = staged(crossing(parts.select("node", "meeting", "size", "bytes", F.coalesce("root", "node").alias("part")), threshold, 4 * block), "split")
    if across.head(1):
        again = across.join(texts.hint("merge"), F.col("node") == F.col("id"))
        roots = staged(connected_components(found.union(staged(links(again), "near_again")), "a", "b"), "near_roots")
    named = classes.select("digest", "node").join(roots.hint("merge"), "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return digests.join(named.hint("merge"), "digest").select(F.col("id").alias(id_col), "component_id")
