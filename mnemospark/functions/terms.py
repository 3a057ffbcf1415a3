"""Tokens and stems of whole tables, in Arrow batches.

The column expressions of ``text`` apply the stemmer's steps to every token; here each distinct word is stemmed once for a
worker and looked up from then on, which is many times cheaper over a corpus.  Both give the same terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T

#: Words that a worker keeps the terms of.
MOST_WORDS = 200_000

_token = re.compile(T.TOKEN)
_suffix = re.compile(f"(?:{'|'.join(T.SUFFIXES)})\\Z")
_whole = T._whole_form()
_stopwords = frozenset(T.STOPWORDS)


def stem(word: str) -> str:
    word = _whole.get(word, word)
    if len(word) <= 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _suffix.sub("", word)
    if len(word) >= 4 and word[-1] == word[-2] and word[-1] in T.DOUBLES:
        word = word[:-1]
    if len(word) >= 4 and word[-1] == "e" and word[-2] != "e":
        word = word[:-1]
    if len(word) > 3 and word[-1] == "y" and word[-2] not in "aeiou":
        word = word[:-1] + "i"
    return word


class Terms(dict):
    """Raw token -> its term, or None for one that isn't kept; filled as tokens come."""

    def __init__(self, stemming: bool):
        super().__init__()
        self.stemming = stemming

    def __missing__(self, raw: str) -> str | None:
        if len(self) >= MOST_WORDS:
            self.clear()
        word = raw.strip("'_-")
        kept = None if len(word) < 2 or word in _stopwords else stem(word) if self.stemming else word
        self[raw] = kept
        return kept

    def of(self, text: str | None) -> list[str]:
        return [t for t in map(self.__getitem__, _token.findall(text.lower())) if t is not None] if text else []


_held: dict[bool, Terms] = {}


def tokenized(df: DataFrame, text: str = "text", out: str = "terms", stemming: bool = True) -> DataFrame:
    """``df`` with the array of terms of ``text`` as ``out`` in the place of ``text``; a null text has none."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"`{out}` array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mnemospark.functions import terms  # the worker's own module, which outlives the task

        own = terms._held.setdefault(stemming, Terms(stemming))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = pa.array([own.of(t) for t in part.column(len(kept)).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*kept, out])

    return df.select(*kept, F.col(text)).mapInArrow(run, schema)


def counted(df: DataFrame, text: str = "text", out: str = "term", stemming: bool = True) -> DataFrame:
    """``out``, n: how often each term occurs in all of ``text``; a task adds up its own texts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mnemospark.functions import terms  # the worker's own module, which outlives the task

        own, found = terms._held.setdefault(stemming, Terms(stemming)), Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=[out, "n"])

        for given in batches:
            for t in given.column(0).to_pylist():
                found.update(own.of(t))
                if len(found) >= MOST_WORDS:
                    yield batch()
                    found.clear()
        yield batch()

    return df.select(text).mapInArrow(run, f"`{out}` string, n long").groupBy(out).agg(F.sum("n").alias("n"))
