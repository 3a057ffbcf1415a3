"""Packing by concatenating and cutting.

Pass 1 encodes each document where it is read, appends the end id and writes the ids with their offset
among the partition's own ids; the totals of the partitions (one number each) go through a prefix sum
on the driver.  Pass 2 adds each partition's global offset and cuts the endless sequence at multiples of the
window: a document over a cut gives one record on either side of it.  No row is shuffled.  The order is
that of the partitions of pass 1, fixed by the table it writes.

Defined cases: a null or empty text is its end id alone; repeated rows and null or repeated doc_ids are packed
one by one; only the last sequence is padded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import tokens
from mnemospark.llm.common import persist, tidied

WINDOW = 1024
END_ID = 0

_ENCODED = "part int, doc_id long, start_in_part long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encoded(docs: DataFrame, tokenizer: str | None, end_id: int) -> DataFrame:
    spec = tokens.load(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens.encoder(spec), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], enc.kind).tobytes(), np.dtype(enc.kind).itemsize
        for batch in batches:
            for lo, texts in tokens.slices(batch.column(1)):
                docs_here = batch.column(0).slice(lo, len(texts))
                ids = [own.tobytes() + end for own in enc.encode_many(texts)]
                n = np.array([len(b) // width for b in ids], dtype=np.int64)
                starts = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, dtype=np.int32)), docs_here, pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "doc_id", "start_in_part", "n", "ids"])

    return persist(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run, keep=True), _ENCODED), "pack-ids")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids in the width of the vocabulary (two bytes up to 65,536 entries).
    """
    spark = docs.sparkSession
    encoded = _encoded(docs, tokenizer, end_id)
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row for each partition
    base = np.concatenate([[0], np.cumsum([r.n for r in totals])]).tolist()
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(totals, base, strict=False)], "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width, done = len(ids) // n, 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    length = min(n - done, window - off)
                    for column, value in zip(out, (doc, done, length, ids[done * width:(done + length) * width], n, seq, off), strict=True):
                        column.append(value)
                    done += length
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = encoded.join(F.broadcast(offsets), "part")
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("at"), "n", "ids").mapInArrow(tidied(cut), _PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ids_crc32 (of the ids as unsigned 32-bit integers) in the place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = {2: "<u2", 4: "<u4"}
            crc = [tokens.crc_u32(np.frombuffer(b, dtype=width[len(b) // n])) for b, n in zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            i = batch.schema.get_field_index("ids")
            columns = [pa.array(crc, pa.int64()) if k == i else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["ids_crc32" if x == "ids" else x for x in batch.schema.names])

    return pieces.mapInArrow(tidied(run), _PIECES.replace("ids binary", "ids_crc32 long"))
