"""Line-addressable chunks: a fold over the lines of each document, in Arrow batches, in parallel over documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions import time as D
from mnemospark.functions.terms import tokenized

MAX_CHARS, MIN_CHARS = 900, 200
_heading = re.compile(r"#{1,6}\s")


def fold_lines(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, body) of each chunk: cut before a heading once ``min_chars`` are held, after a blank line
    from ``max_chars`` on, and after any line from 1.6 times that on."""
    held: list[str] = []
    size, first = 0, 1
    lines = re.split(r"\r?\n", text)
    for number, line in enumerate(lines, 1):
        if held and size >= min_chars and _heading.match(line):
            yield first, number - 1, "\n".join(held).strip()
            held, size = [], 0
        first = first if held else number
        held.append(line)
        size += len(line) + 1
        if size >= max_chars * 1.6 or (size >= max_chars and not line.strip()):
            yield first, number, "\n".join(held).strip()
            held, size = [], 0
    if held:
        yield first, len(lines), "\n".join(held).strip()


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ``carry``, chunk_no, start_line, end_line, text, date of the printable, non-empty chunks."""
    held = docs.select(key, *carry)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, i, a, b, body) for at, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if t for i, (a, b, body) in enumerate(fold_lines(t)) if body]
            own = [c.take(pa.array([r[0] for r in rows], pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3)], pa.array([r[4] for r in rows], pa.string())],
                names=[*batch.schema.names[:-1], "chunk_no", "start_line", "end_line", "text"])

    made = docs.select(key, *carry, F.col(text).alias("__text")).mapInArrow(run, f"{kept}, chunk_no int, start_line int, end_line int, text string")
    return made.where(T.mostly_printable(F.col("text"))).withColumn("date", D.extract_date(F.col("text")))


def chunk_files(texts: DataFrame) -> DataFrame:
    """Chunks of files (source, mtime, text) with their time: the date in the chunk, else the file's."""
    made = chunk(texts, "source", "text", ("mtime",))
    return made.withColumn("when_ts", F.coalesce(D.date_to_time(F.col("date")), F.col("mtime")))


def records(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Chunks with id, fnv (the short id), terms and len; chunks without a token are left out."""
    head = F.concat(F.col(source), F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), F.substring("text", 1, 64))
    made = tokenized(chunks.withColumns({"id": F.sha2(head.cast("binary"), 256), "fnv": T.fnv1a(head), "__raw": F.col("text")}), "__raw")
    return made.withColumn("len", F.size("terms")).where("len > 0")
