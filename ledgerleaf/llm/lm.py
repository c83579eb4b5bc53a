"""Bigram language-model scores by deleted interpolation.

Documents are gathered into batches of bounded size, each written once as a
file of local word numbers. A batch asks for the corpus counts of its distinct
words and word pairs: the requests, sorted 64-bit hashes with the batch's own
training counts, are dealt out by hash range, summed there over all batches,
and answered with the totals in the same order. A batch sends a row only to
ranges that hold keys of its own, so rows never outnumber a corpus's distinct
(batch, key) pairs. A frequent word or pair is one entry a batch in its range,
however often it occurs.

The model mixes the maximum-likelihood estimates of pair, word and uniform
with weights for each bucket of the context's frequency. The weights come from
expectation-maximisation on held-out counts: every training token is held out
in turn, that is, its own occurrence is deleted from all counts. The driver
sees these as a histogram of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import bytewords as bw
from ledgerleaf.llm.staging import new_path, staged

_U = np.uint64
END = _U(0x243F6A8885A308D3)
#: Tokens of a batch, beyond which it is closed; tokens of the corpus for each range of keys.
BATCH, RANGE = 1_500_000, 2_000_000
#: Buckets of context frequency (powers of two) and histogram bins of a probability (half powers of two).
BUCKETS, BINS = 26, 64


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of an integer array by place value, compressed."""
    size = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, size).T.tobytes())


def _expand(blob: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def write_batches(docs: DataFrame, path: str, held: str, id_col: str, text_col: str) -> DataFrame:
    """Write batch files under ``path``; returns their manifest (batch, file, n_tokens) of the tasks that succeeded."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        out: list[pa.Array] = []
        lens: list[np.ndarray] = []
        toks: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            tok = np.concatenate(toks)
            vocab, local = np.unique(tok, return_inverse=True)
            name = f"{part:08d}-{seq:05d}-{uuid.uuid4().hex}.parquet"
            row = pa.table({
                "ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                "held": pa.ListArray.from_arrays(pa.array([0, sum(map(len, out))], pa.int32()), pa.concat_arrays(out)),
                "lens": [np.concatenate(lens).astype(np.int32)], "vocab": [vocab.tobytes()], "local": [_squeeze(local.astype(np.uint32))],
            })
            pq.write_table(row, f"{root}/{name}", filesystem=store, compression="zstd", use_dictionary=False)
            got = pa.RecordBatch.from_pydict({"batch": [part * (1 << 24) + seq], "file": [name], "n_tokens": [len(tok)]})
            seq += 1
            for x in (ids, out, lens, toks):
                x.clear()
            return got

        for batch in bw.slices(batches, "text"):
            data, offsets = bw.buffer(batch.column("text"))
            data = bw.LOWER[data]
            start, end, first = bw.words(data, offsets)
            n = np.diff(first)
            tok = np.full(len(start) + len(n), END)
            tok[np.arange(len(start)) + np.repeat(np.arange(len(n)), n)] = bw.hash_spans(data, start, end)
            ids.append(batch.column("id"))
            out.append(batch.column("held"))
            lens.append(n + 1)
            toks.append(tok)
            if sum(map(len, toks)) >= BATCH:
                yield close()
        if toks:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.expr(held).alias("held"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(write, "batch long, file string, n_tokens long"), "batches")


class Batch:
    """A batch file in memory: tokens, their pairs, and the distinct keys of both."""

    def __init__(self, store: fs.FileSystem, name: str):
        row = pq.read_table(name, filesystem=store)
        self.ids = row.column("ids").combine_chunks().values
        self.held = row.column("held").combine_chunks().values.to_numpy(zero_copy_only=False)
        self.lens = row.column("lens").combine_chunks().values.to_numpy().astype(np.int64)
        self.vocab = np.frombuffer(row.column("vocab")[0].as_py(), np.uint64)
        self.local = _expand(row.column("local")[0].as_py(), np.uint32)
        self.first = np.cumsum(self.lens) - self.lens
        self.trained = np.repeat(~self.held, self.lens)
        # the context of a document's first token is the end token
        at_end = int(np.searchsorted(self.vocab, END))
        self.before = np.empty_like(self.local)
        self.before[1:] = self.local[:-1]
        self.before[self.first] = at_end
        pair = bw.mix(self.vocab[self.before] * bw.MULTIPLIER + (self.vocab ^ END)[self.local])
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def keys(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of a level and the number of training tokens of each."""
        keys, place = (self.vocab, self.local) if level == 1 else (self.pairs, self.pair)
        return keys, np.bincount(place[self.trained], minlength=len(keys)).astype(np.uint32)


def _parts(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that hold any of these sorted keys, and where each begins among them (one more at the end)."""
    part = ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, np.diff(part) != 0)[: len(part)])
    return part[begin], np.append(begin, len(keys))


def corpus_counts(manifest: DataFrame, path: str, ranges: int) -> DataFrame:
    """Answers to all batches' requests: (batch, level, part, counts), and for each range a row of batch -1 with its token and type numbers."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for rows in batches:
            for row in rows.to_pylist():
                own = Batch(store, f"{root}/{row['file']}")
                for level in (1, 2):
                    keys, counts = own.keys(level)
                    part, cut = _parts(keys, ranges)
                    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    blobs = [[_squeeze(np.diff(keys[i:j], prepend=_U(0))) for i, j in spans], [_squeeze(counts[i:j]) for i, j in spans]]
                    same = lambda v: pa.array(np.full(len(spans), v, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(part), same(row["batch"]), same(level), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], ["part", "batch", "level", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.select(["part", "batch", "level", "keys", "counts"]).to_pylist()
        out = {k: [] for k in ("batch", "level", "part", "counts", "tokens", "types")}
        for level in (1, 2):
            own = [r for r in rows if r["level"] == level]
            if not own:
                continue
            keys = [np.cumsum(_expand(r["keys"], np.uint64), dtype=np.uint64) for r in own]
            counts = [_expand(r["counts"], np.uint32) for r in own]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts)).astype(np.int64)
            at = 0
            for r, k in zip(own, keys, strict=True):
                values = total[place[at : at + len(k)]]
                at += len(k)
                for name, v in (("batch", r["batch"]), ("level", level), ("part", r["part"]), ("counts", _squeeze(values)), ("tokens", None), ("types", None)):
                    out[name].append(v)
            for name, v in (("batch", -1), ("level", level), ("part", own[0]["part"]), ("counts", None), ("tokens", int(total.sum())), ("types", int((total > 0).sum()))):
                out[name].append(v)
        return pa.table({"batch": pa.array(out["batch"], pa.int64()), "level": pa.array(out["level"], pa.int64()), "part": pa.array(out["part"], pa.int64()), "counts": pa.array(out["counts"], pa.binary()), "tokens": pa.array(out["tokens"], pa.int64()), "types": pa.array(out["types"], pa.int64())})

    # the manifest is small for what it stands for, so its tasks are not left to sizes
    asked = manifest.repartition(max(1, manifest.count()), "batch").mapInArrow(ask, "part long, batch long, level long, keys binary, counts binary")
    return staged(asked.groupBy("part").applyInArrow(answer, "batch long, level long, part long, counts binary, tokens long, types long"), "counts")


def _estimates(own: Batch, answers: list[dict], n: int, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: its count, its context's bucket, and its pair and word estimates; ``deleted`` takes one occurrence out of each count."""
    by = {level: np.concatenate([_expand(a["counts"], np.int64) for a in sorted((x for x in answers if x["level"] == level), key=lambda x: x["part"])]) for level in (1, 2)}
    count, context, pair = by[1][own.local], by[1][own.before], by[2][own.pair]
    less = own.trained.astype(np.int64) if deleted else 0
    bucket = np.minimum(np.frexp(np.maximum(context - less, 0).astype(np.float64))[1], BUCKETS - 1)
    p2 = np.where(context - less > 0, (pair - less) / np.maximum(context - less, 1), 0.0)
    return count, bucket, p2, (count - less) / max(n - int(deleted), 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for a zero, otherwise the half power of two."""
    return np.where(p > 0, np.clip(1 + np.floor(-2 * np.log2(np.maximum(p, 1e-300))), 1, BINS - 1), 0).astype(np.int64)


def interpolation_weights(cells: np.ndarray, numbers: np.ndarray, types: int, rounds: int = 200) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform by EM on the histogram of held-out estimates.

    A bucket without held-out tokens takes the weights of the nearest bucket
    below that has some, or of word and uniform alone.
    """
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    centre = np.where(np.arange(BINS) == 0, 0.0, 2.0 ** -((np.arange(BINS) - 0.5) / 2))
    bucket, rest = np.divmod(cells, BINS * BINS)
    known = weights[0]
    for b in range(BUCKETS):
        mine = bucket == b
        if mine.any():
            p = np.stack([centre[rest[mine] // BINS], centre[rest[mine] % BINS], np.full(int(mine.sum()), 1 / (types + 1))], axis=1)
            w, n = np.array([0.4, 0.5, 0.1]), numbers[mine]
            for _ in range(rounds):
                share = p * w
                share /= share.sum(axis=1, keepdims=True)
                w = (n @ share) / n.sum()
            known = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
        weights[b] = known
    return weights


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, rest: int = 0) -> DataFrame:
    """Scores of every text: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Counts come from rows whose crc32 of the id as text, modulo ``modulus``,
    is not ``rest``; null ids count as training rows. Both scores are log10
    probabilities of all words and the end. Null and empty texts are the end
    alone. Repeated rows each count and return; without training rows the
    counts are zero and the model is uniform; an empty table gives none.
    Words are told apart by 64-bit hashes.
    """
    path = new_path(docs.sparkSession, "lm")
    held = f"coalesce(crc32(cast(`{id_col}` as string)) % {modulus} = {rest}, false)"
    manifest = write_batches(docs, path, held, id_col, text_col)
    tokens = manifest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    counts = corpus_counts(manifest, path, max(1, int(tokens // RANGE)))
    n, types = counts.where("batch = -1 and level = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    answers = counts.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("level", "part", "counts")).alias("answers"))
    work = manifest.join(answers.hint("merge"), "batch").select("file", "answers")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        total = np.zeros(BUCKETS * BINS * BINS, np.int64)
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                own = Batch(store, f"{root}/{row['file']}")
                _, bucket, p2, p1 = _estimates(own, row["answers"], n, True)
                cell = (bucket * BINS + _bin(p2)) * BINS + _bin(p1)
                total += np.bincount(cell[own.trained], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = work.mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = interpolation_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(), types)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                own = Batch(store, f"{root}/{row['file']}")
                count, bucket, p2, p1 = _estimates(own, row["answers"], n, False)
                w = weights[bucket]
                model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1))
                base = np.log10((count + 0.1) / (n + 0.1 * (types + 1)))
                add = lambda x: np.add.reduceat(x, own.first)  # noqa: B023, E731
                size = len(own.lens)
                yield pa.RecordBatch.from_arrays(
                    [own.ids, pa.array(own.held), pa.array(own.lens), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(size, n, np.int64)), pa.array(add(base)), pa.array(add(model))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = work.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
