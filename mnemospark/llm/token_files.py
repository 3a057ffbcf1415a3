"""Token ids in files of independent zstandard frames.

A file is: one frame for each document (its ids as little-endian integers, two or four bytes wide), a skippable
frame with the documents' numbers and the width, and a skippable frame with the seek table of the
public seekable format (compressed size, size and checksum of each frame, then a footer).  A reader takes the
tail, finds a document's frame by its number and decompresses that alone; the checksum is the low half of
the frame's XXH64.

``write_tokens`` deals the documents out by ranges of doc_id, so that the files in their order hold ascending
doc_ids, and encodes each range in one task.  Files are written beside their place and renamed,
so a task that runs again leaves the same file.

Defined cases: a null or empty text is its end id alone; null doc_ids come first; rows of one doc_id stand
in the order of their texts' hashes; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import tokens
from mnemospark.llm.common import partitions_for, scratch, text_key, tidied

# Fixed values of the seekable format.
SKIPPABLE_DOCS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NULL_ID = -(1 << 63)

END_ID = 2


def _filesystem(uri: str):
    """The file system and path of ``uri``; a plain path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes one file; ``close`` puts the document table and the seek table at its end."""

    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width, self.table, self.docs = stream, width, bytearray(), []
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.zstd.compress(ids)
        self.stream.write(frame)
        self.table += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.docs.append(NULL_ID if doc_id is None else doc_id)

    def close(self) -> None:
        docs = struct.pack("<II", self.width, len(self.docs)) + np.array(self.docs, dtype="<i8").tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE_DOCS, len(docs)) + docs)
        foot = struct.pack("<IBI", len(self.docs), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_TABLE, len(self.table) + len(foot)) + self.table + foot)
        self.stream.close()


class Reader:
    """Reads one file: ``doc_ids`` and ``ids(i)`` of the document at place ``i``, decompressing its frame alone."""

    def __init__(self, file):
        import zstandard

        self.file, size = file, file.size()
        foot = self._at(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", foot)
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a file of seekable frames with checksums")
        start = size - 9 - 12 * n
        table = np.frombuffer(self._at(start, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.sums = table[:, 0], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        head = self._at(int(self.starts[-1]) + 8, 8 + 8 * n)
        self.width, _ = struct.unpack("<II", head[:8])
        self.doc_ids = [None if x == NULL_ID else x for x in np.frombuffer(head[8:], dtype="<i8").tolist()]
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def ids(self, i: int) -> np.ndarray:
        import xxhash

        raw = self.zstd.decompress(self._at(int(self.starts[i]), int(self.sizes[i])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"the checksum of frame {i} doesn't hold")
        return np.frombuffer(raw, dtype=f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of all documents below ``path``; returns the manifest: part, file, n_docs, n_ids, start."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    spec = tokens.load(spark, tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(docs).alias("k"))
    ranged = rows.repartitionByRange(partitions_for(rows), "doc_id", "k").sortWithinPartitions("doc_id", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, n, total = TaskContext.get().partitionId(), None, 0, 0
        enc = tokens.encoder(spec)
        end, width = np.array([end_id], enc.kind).tobytes(), np.dtype(enc.kind).itemsize
        fs, root = _filesystem(path)
        name = f"{root}/part-{part:06d}.tok"
        mine = f"{root}/.{uuid.uuid4().hex}"
        for batch in batches:
            if writer is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                writer = Writer(fs.open_output_stream(mine), width)
            for lo, texts in tokens.slices(batch.column(1)):
                for doc, own in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), enc.encode_many(texts), strict=True):
                    ids = own.tobytes() + end
                    writer.add(doc, ids)
                    n, total = n + 1, total + len(ids) // width
        if writer is not None:
            writer.close()
            fs.move(mine, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n], "n_ids": [total]})

    files = ranged.select("doc_id", "text").mapInArrow(tidied(run, keep=True), "part int, file string, n_docs long, n_ids long").collect()
    files.sort(key=lambda f: f.part)  # a row for each file; an orderBy would run the encoding a second time, to sample it
    starts = np.concatenate([[0], np.cumsum([f.n_ids for f in files])]).tolist()
    made = [(f.part, _uri(path, f.file), f.n_docs, f.n_ids, s) for f, s in zip(files, starts, strict=False)]
    return spark.createDataFrame(made, "part int, file string, n_docs long, n_ids long, start long")


def _uri(path: str, name: str) -> str:
    """The file ``name`` of the folder ``path`` as a URI of the same store."""
    return f"{path.rstrip('/')}/{name.rpartition('/')[2]}"


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, 4 bytes) of each document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = _filesystem(name)
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    for lo in range(0, len(reader.doc_ids), 256):
                        ids = [reader.ids(i) for i in range(lo, min(lo + 256, len(reader.doc_ids)))]
                        n = [len(x) for x in ids]
                        starts = (at + np.concatenate([[0], np.cumsum(n)])).astype(np.int64)
                        at = int(starts[-1])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.doc_ids[lo:lo + 256], pa.int64()), pa.array(starts[:-1]), pa.array(n, pa.int64()),
                            pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])

    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")
