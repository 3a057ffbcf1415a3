"""The text functions for SQL: ``register`` makes them callable in ``spark.sql``.

* ``tokenize(text)``: the array of terms; of a null or empty text an empty one.
* ``snippet(text, terms)``: the 240 characters where most of the terms occur; null for a null text, and null terms are none.
* ``chunks(text)``: a table function, for use with LATERAL: a row (chunk_no, start_line, end_line, body) for each chunk with a body.

Batches travel as Arrow; each function gives what its DataFrame version gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.terms import Terms


def snippet_of(text: str, terms: list[str], width: int = 240) -> str:
    """As ``text.snippet``: from a sixth of ``width`` before the place from which most hits follow within ``width``, the first of equals."""
    lower = text.lower()
    hits = sorted(m.start() for t in terms if t for m in re.finditer(re.escape(t), lower))
    if not hits:
        return text[:width].strip() + ("…" if len(text) > width else "")
    best = max(hits, key=lambda h: (sum(h <= x < h + width for x in hits), -h))
    begin = max(0, best - width // 6)
    end = min(len(text), begin + width)
    return ("…" if begin else "") + text[begin:end].strip() + ("…" if end < len(text) else "")


class Chunks:
    """The rows of ``chunks``."""

    def eval(self, text: str) -> Iterator[tuple]:
        from mnemospark.operators.chunking import fold_lines

        for i, (first, last, body) in enumerate(fold_lines(text)) if text else ():
            if body:
                yield i, first, last, body


def register(spark: SparkSession) -> None:
    """Make ``tokenize``, ``snippet`` and ``chunks`` callable in this session's SQL."""

    @F.arrow_udf("array<string>")
    def tokenize(texts: pa.Array) -> pa.Array:
        own = Terms(True)
        return pa.array([own.of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    @F.arrow_udf("string")
    def snippet(texts: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array([None if t is None else snippet_of(t, [x for x in own or () if x]) for t, own in zip(texts.to_pylist(), terms.to_pylist(), strict=True)], pa.string())

    spark.udf.register("tokenize", tokenize)
    spark.udf.register("snippet", snippet)
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_no int, start_line int, end_line int, body string", useArrow=True))
