"""Toxicity by nearest labelled examples.

The examples are a bounded sample of the labelled documents (``max_examples``, those with the smallest hash of doc_id, one
text for each; documents whose crc32(doc_id) mod 3 is 1 are held out).  Terms are all words of the examples, none is left
out; their document frequencies are counted over all documents.  A vector's weights are (1 + log tf) * idf * (1 + G2), where G2
is the log-likelihood ratio of a term that is likelier in toxic examples (0 for all others, so that they weigh as plain
TF-IDF).  A document is compared with all examples by the exact cosine of these vectors, over the terms that examples have:

* the postings of rare terms are added up;
* common terms lie in blocks of examples, each with the largest weight of every term: those, and the largest sum so far,
  give a block an upper bound;
* blocks are evaluated from the highest bound down until no other can reach the ``k`` nearest.

The neighbours vote with weights of 1 / (distance + 0.05); an isotonic fit over the examples, each voted on without itself,
makes the votes calibrated scores.  The index is bounded by the examples and is broadcast.

Defined cases: a document without any word of the examples, null and empty texts included, gets the rate of such
examples (0 without any); repeated rows are scored one by one; repeated labels of a doc_id count as toxic if one is, and of several
texts of a labelled doc_id the first in order is the example; null labels and null doc_ids don't train; without labels all scores
are 0; an empty table gives an empty result; other columns are ignored, and lang, source, doc_id and labels aren't
inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import doc_hash, persist, rows_without, text_key, tidied

MAX_EXAMPLES = 4_000
NEIGHBOURS = 15
BLOCK = 64
#: A term that more than this share of the examples has is common.
COMMON = 1 / 16
BUCKETS, HELD_OUT = 3, 1
THRESHOLD = 0.7

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def counts_of(text: str | None, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the text's words in the vocabulary, ascending, and how often each occurs."""
    found = np.fromiter(filter(None, map(vocabulary.get, words_of(text))), dtype=np.int64)
    return np.unique(found, return_counts=True)


class Index:
    """A block-max inverted index of the examples' unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_terms: int, block: int = BLOCK, common: float = COMMON):
        # examples whose heaviest terms are the same stand in the same blocks, which makes the bounds tight
        order = self.order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), -round(float(vectors[i][1].max()), 6), i))
        self.labels, self.ids, self.block, self.blocks = labels[order], [ids[i] for i in order], block, -(-len(order) // block)
        at = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        often = np.bincount(term, minlength=n_terms) > max(1, common * len(order))
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        rare = ~often[term]
        by = np.flatnonzero(rare)[np.argsort(term[rare], kind="stable")]
        self.starts = np.searchsorted(term[by], np.arange(n_terms + 1))
        self.rows, self.weights = at[by].astype(np.int32), weight[by]
        heavy = ~rare
        self.dense = np.zeros((max(1, self.blocks), int(often.sum()), block), dtype=np.float32)
        self.dense[at[heavy] // block, self.common[term[heavy]], at[heavy] % block] = weight[heavy]
        self.highest = np.ascontiguousarray(self.dense.max(axis=2).T)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples that share a term; of equal cosines (to 1e-6), those evaluated first."""
        which = self.common[terms]
        heavy = which >= 0
        lo, n = self.starts[terms[~heavy]], self.starts[terms[~heavy] + 1] - self.starts[terms[~heavy]]
        posts = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sums = np.bincount(self.rows[posts], weights=self.weights[posts] * np.repeat(weights[~heavy], n), minlength=self.blocks * self.block)
        if skip >= 0:
            sums[skip] = -2
        sums = sums.reshape(self.blocks, self.block)
        which, query = which[heavy], weights[heavy].astype(np.float32)
        bounds = sums.max(axis=1, initial=-2) + query @ self.highest[which] + 1e-5
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 1e-5 or len(cosines) >= k and bounds[b] <= cosines[-1]:
                break
            score = sums[b] + query @ self.dense[b].take(which, axis=0)
            at = np.flatnonzero(score > (cosines[-1] if len(cosines) >= k else 1e-9))
            if not len(at):
                continue
            places, cosines = np.concatenate([places, at + b * self.block]), np.concatenate([cosines, score[at]])
            best = np.argsort(-cosines, kind="stable")[:k]
            places, cosines = places[best], cosines[best]
        return places, cosines

    def vote(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[float, list]:
        places, cosines = self.nearest(terms, weights, k, skip)
        if not len(places):
            return 0.0, []
        w = 1 / (np.maximum(0, 1 - cosines) + 0.05)
        return float((w * self.labels[places]).sum() / w.sum()), [self.ids[p] for p in places[:5]]


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and calibrated scores (never falling) between which to interpolate; blocks are smoothed by half a row of each label."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for v, y in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        blocks.append([v, v, y, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3] or blocks[-2][1] == blocks[-1][0]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    xs = np.array([x for b in blocks for x in (b[0], b[1])])
    ys = np.array([y for b in blocks for y in [(b[2] + 0.5) / (b[3] + 1)] * 2])
    return xs, np.maximum.accumulate(ys) if len(ys) else ys


def lean(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """G2 of each term (in so many toxic and clean examples) against the examples' rate, 0 where it isn't likelier in toxic ones."""
    n, rate = toxic + clean, (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    part = lambda x, share: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(n * share, 1e-9)), 0.0)
    return np.where(toxic > n * rate, 2 * (part(toxic, rate) + part(clean, 1 - rate)), 0.0)


class Model:
    """The examples (doc_id, toxic, numbers of its terms, counts) as an index, with calibrated votes.  ``vocabulary`` numbers from 1 on."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, examples: list, k: int):
        self.vocabulary, self.k = vocabulary, k
        full = [e for e in examples if len(e[2])]
        bare = [e[1] for e in examples if not len(e[2])]
        self.bare = sum(bare) / len(bare) if bare else 0.0
        size = len(idf)
        counted = [np.bincount(np.concatenate([e[2] for e in full if e[1] == y] or [np.zeros(0, np.int64)]), minlength=size) for y in (1, 0)]
        labels = np.array([e[1] for e in full], dtype=np.float64)
        self.weight = idf * (1 + lean(*counted, int(labels.sum()), int((1 - labels).sum())))
        vectors = [self.vector(e[2], e[3]) for e in full]
        self.index = Index(vectors, labels, [e[0] for e in full], size)
        place = {i: p for p, i in enumerate(self.index.order)}
        votes = np.array([self.index.vote(*v, k, skip=place[i])[0] for i, v in enumerate(vectors)])
        self.xs, self.ys = isotonic(votes, labels)
        self.index.order = []

    def vector(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(times)) * self.weight[terms]
        norm = np.linalg.norm(w)
        return terms, w / norm if norm else w

    def score(self, text: str | None) -> tuple[float, list]:
        terms, times = counts_of(text, self.vocabulary)
        if not len(terms) or not len(self.xs):
            return self.bare, []
        raw, evidence = self.index.vote(*self.vector(terms, times), self.k)
        return float(np.interp(raw, self.xs, self.ys)), evidence


def _examples(docs: DataFrame, labels: DataFrame, max_examples: int, buckets: int, held_out: int) -> tuple[dict[bytes, int], list[tuple]]:
    """The vocabulary, numbered from 1 on in order, and (doc_id, toxic, numbers of its words, counts) of the examples, at most ``max_examples``."""
    rule = F.pmod(doc_hash(), F.lit(buckets)) != held_out
    known = labels.where(rule & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).select(F.col("doc_id").cast("long").alias("sample_id"), "toxic")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([list(c.keys()) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "words", "times"])

    made = rows.mapInArrow(tidied(run), "doc_id long, toxic int, words array<binary>, times array<long>")
    seen: dict[bytes, int] = {}
    numbered = [
        (r.doc_id, r.toxic, np.array([seen.setdefault(bytes(w), len(seen)) for w in r.words], dtype=np.int64), np.array(r.times, dtype=np.int64))
        for r in made.toLocalIterator()]
    vocabulary = {w: i for i, w in enumerate(sorted(seen), 1)}
    place = np.fromiter(map(vocabulary.__getitem__, seen), dtype=np.int64, count=len(seen))
    out = []
    for doc_id, toxic, words, times in sorted(numbered, key=lambda e: e[0]):
        terms = place[words]
        by = np.argsort(terms)
        out.append((doc_id, toxic, terms[by], times[by]))
    return vocabulary, out


def _document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each term (0 at place 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df = shared.value, np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for text in batch.column(0).slice(lo, 512).to_pylist():
                    df[counts_of(text, own)[0]] += 1
                df[0] += min(512, batch.num_rows - lo)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    shared.destroy()
    out = np.zeros(len(vocabulary) + 1, dtype=np.float64)
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    total, out[0] = int(out[0]), 0
    return total, out


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, buckets: int = BUCKETS, held_out: int = HELD_OUT) -> Model:
    vocabulary, examples = _examples(docs, labels, max_examples, buckets, held_out)
    total, df = _document_frequencies(docs, vocabulary)
    return Model(vocabulary, np.log((total + 1) / (df + 1)), examples, k)


def score(docs: DataFrame, model: Model | Broadcast) -> DataFrame:
    """doc_id, text_key, score, evidence (doc_ids of the nearest examples) for each row."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [own.score(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, text_key long, score double, evidence array<long>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for each row."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (F.pmod(doc_hash(), F.lit(BUCKETS)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    found = persist(score(docs, shared).where(F.col("score") >= threshold).select("doc_id", "text_key").distinct(), "toxic")
    shared.destroy()  # the result is written: nothing is left that could need the model again
    return rows_without(docs, found)
