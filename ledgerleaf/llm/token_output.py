"""Token ids as flat binary files with 64-bit document offsets, read back by memory map.

Layout of a corpus: for each part, in ascending order of document id,
``<part>.bin`` holds all ids as little-endian unsigned integers, of 16 bits if
the vocabulary fits and 32 otherwise, and ``<part>.idx`` holds n + 1 little-endian 64-bit offsets (in ids, from 0)
followed by the n document ids as 64-bit integers. A manifest table names the
files of the tasks that succeeded. A part's base, the number of ids before it
in the corpus, is a prefix sum over the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm import tokens
from ledgerleaf.llm.staging import new_path, staged

NULL_ID = -(1 << 63)
#: Ids that a reader holds at once.
BLOCK = 4 << 20


def write_corpus(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` to each and write the files under ``path``; returns the manifest.

    Documents are dealt out by ranges of their id and sorted, so that part
    after part gives ascending ids; equal ids keep together in one part.
    Null and empty texts hold the end id only; null ids come first. A task
    writes files under names of its own, so that a retried or doubled task
    leaves only files that no manifest row names. An empty table gives an
    empty manifest. Columns other than the two named are not read.
    """
    tokenizer = tokenizer or tokens.default_path()

    width = tokens.id_width(tokenizer, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        total = docs_seen = 0
        out = None
        for batch, flat, offsets in tokens.encoded(batches, tokenizer):
            out = out or store.open_output_stream(f"{root}/{name}.bin")
            n = batch.num_rows
            full = np.full(len(flat) + n, end_id, dtype=f"<u{width}")
            full[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))] = flat
            out.write(full.tobytes())
            sizes.append(np.diff(offsets) + 1)
            ids.append(batch.column("id").to_numpy(zero_copy_only=False))
            total, docs_seen = total + len(full), docs_seen + n
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8").tobytes())
            index.write(np.concatenate(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [name], "n_docs": [docs_seen], "n_tokens": [total], "width": [width]})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("id").sortWithinPartitions("id")
    return staged(dealt.mapInArrow(write, "part long, file string, n_docs long, n_tokens long, width long"), "manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each part's base. It has one row for each file, so the one sorted pass is short."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_corpus(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32.

    Files are memory-mapped where the store is a local folder and read in
    blocks elsewhere, so a reader holds ``BLOCK`` ids or one document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                with store.open_input_file(f"{root}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<i8")
                offsets, ids = index[: n + 1], index[n + 1 :]
                with _opened(store, f"{root}/{row['file']}.bin") as data:
                    at = 0
                    while at < n:
                        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1)
                        base = int(offsets[at])
                        data.seek(row["width"] * base)
                        ids32 = np.frombuffer(data.read(row["width"] * (int(offsets[to]) - base)), dtype=f"<u{row['width']}").astype("<u4")
                        block = memoryview(ids32.tobytes())
                        cut = ((offsets[at : to + 1] - base) * 4).tolist()
                        crc = [zlib.crc32(block[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[at:to]), pa.array(offsets[at:to] + row["base"]), pa.array(np.diff(offsets[at : to + 1])), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to

    parts = staged(with_bases(manifest), "parts")
    # one task for each file: the manifest is small for what it stands for
    rows = parts.repartition(max(1, parts.count()), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def _opened(store: fs.FileSystem, name: str) -> pa.NativeFile:
    return pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name)


def token_corpus(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a corpus in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "corpus")
    return read_corpus(docs.sparkSession, write_corpus(docs, path, tokenizer, end_id), path)
