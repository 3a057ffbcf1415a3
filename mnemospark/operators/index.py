"""A stored inverted index: postings in blocks by term, read for the terms of the queries alone.

``append`` turns records into runs of postings where they stand (one row for each term of the records that a task holds at once, in arrays) and
packs the runs of a term into blocks of at most ``BLOCK`` postings in the order of their keys.  Keys and places are stored as differences, which Parquet packs well.  Files lie in folders
by the hash of their term, so a query opens the folders of its terms and no others.  A term may be in any share of the records: each folder is
split into slices of keys, so no task holds the postings of a term whole.  ``append`` adds records as a further part of the index; df, length
and number of records add up over the parts.

Each block has its number of postings, its largest tf and its smallest len / tf.  Both together bound the BM25 part of every posting in
the block whatever the average length is, so bounds stay true when records are added.  ``topk`` uses them: see there.

Defined cases: records without terms are kept (for their other columns) but count nowhere; a term that no record has gives no rows; an
index of nothing gives empty results.  Keys are unique longs over all parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import pointers, ranking
from mnemospark.operators.scratch import written

BLOCK = 128
BUCKETS = 64
#: Records of a slice: a task of the build has at most so many postings of one term.
SLICE = 1_000_000
#: Tokens whose postings a task makes or packs at once, and places that it reads back at once.
TOKENS, PLACES = 1_000_000, 250_000
#: Query terms that are broadcast, and candidates of all queries that are; with more of them, terms are joined and all blocks are read.
TERMS, CANDIDATES = 200_000, 200_000
POSTINGS = "term string, n int, base long, last long, gaps array<long>, tf array<int>, len array<int>, places array<int>, max_tf int, min_ratio double, bucket int"
#: A score less than this below the threshold may still tie with it when it is rounded to nine digits.
MARGIN = 1e-8


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """``values``, one after the other, as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _begins(changed: np.ndarray) -> np.ndarray:
    """Where runs begin, if ``changed`` tells it of all values but the first."""
    return np.flatnonzero(np.r_[True, changed])


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``, of one row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _postings(recs: DataFrame, key: str, slices: int) -> DataFrame:
    """slice, term, base and keys, tf, len, places of runs of postings: those of one term in records that stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in _chunks(_lengths(whole.column(1)) + 1, TOKENS):
                batch = whole.slice(lo, hi - lo)
                lens, keys = _lengths(batch.column(1)), batch.column(0).to_numpy()
                words = batch.column(1).flatten().dictionary_encode()
                if not len(words):
                    continue
                doc = np.repeat(np.arange(len(keys)), lens)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
                part = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices
                run_of = words.indices.to_numpy().astype(np.int64) * slices + part[doc]
                order = np.argsort(run_of, kind="stable")
                doc, pos, run_of = doc[order], pos[order], run_of[order]
                posts = _begins((doc[1:] != doc[:-1]) | (run_of[1:] != run_of[:-1]))
                tf = np.diff(np.r_[posts, len(doc)])
                places = np.diff(pos, prepend=0)
                places[posts] = pos[posts]
                doc, run_of = doc[posts], run_of[posts]
                runs = _begins(run_of[1:] != run_of[:-1])
                size, bounds = np.diff(np.r_[runs, len(doc)]), np.add.reduceat(tf, runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run_of[runs] % slices, pa.int32()), words.dictionary.take(pa.array(run_of[runs] // slices)), pa.array(keys[doc[runs]]), _lists(keys[doc], size, pa.int64()),
                     _lists(tf, size, pa.int32()), _lists(lens[doc], size, pa.int32()), _lists(places, bounds, pa.int32())], names=["slice", "term", "base", "keys", "tf", "len", "places"])

    return recs.select(F.col(key).cast("long"), "terms").mapInArrow(run, "slice int, term string, base long, keys array<long>, tf array<int>, len array<int>, places array<int>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (bucket, term, keys, tf, len, places), in the order of terms, as blocks; of the last term a part of a block at most is carried on."""
    rest: pa.RecordBatch | None = None
    for whole in batches:
        for lo, hi in _chunks(_lengths(whole.column(5)), TOKENS):
            given = whole.slice(lo, hi - lo)
            made, rest = _cut(given if rest is None else pa.concat_batches([rest, given]))
            yield made
    if rest is not None:
        yield _cut(rest, True)[0]


def _cut(runs: pa.RecordBatch, all_: bool = False) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The blocks of ``runs``; the postings of its last term that don't fill a block are given back, unless ``all_``."""
    size = _lengths(runs.column(2))
    keys, tf, lens, places = (runs.column(i).flatten().to_numpy() for i in (2, 3, 4, 5))
    firsts = _begins(pc.not_equal(runs.column(1)[1:], runs.column(1)[:-1]).to_numpy(zero_copy_only=False))
    of_row = np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, len(size)]))
    term = np.repeat(of_row, size)
    if not ((keys[1:] > keys[:-1]) | (term[1:] != term[:-1])).all():
        order, at = np.lexsort((keys, term)), np.cumsum(tf) - tf
        places = places[ranking._gathered(at[order], tf[order])]
        keys, tf, lens = keys[order], tf[order], lens[order]
    starts = _begins(term[1:] != term[:-1])
    within = np.arange(len(term)) - np.repeat(starts, np.diff(np.r_[starts, len(term)]))
    rest, left = None, 0
    if not all_ and (left := (within[-1] + 1) % BLOCK):
        i, words = len(keys) - left, int(tf[len(keys) - left:].sum())
        last = [*(runs.column(c).slice(len(size) - 1) for c in (0, 1)), *(_lists(x, np.array([len(x)]), k) for x, k in (
            (keys[i:], pa.int64()), (tf[i:], pa.int32()), (lens[i:], pa.int32()), (places[len(places) - words:], pa.int32())))]
        rest = pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(last, runs.schema, strict=True)], schema=runs.schema)
        keys, tf, lens, places, term, within = keys[:i], tf[:i], lens[:i], places[:len(places) - words], term[:i], within[:i]
    names, types = [c.split()[0] for c in POSTINGS.split(", ")], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.int32(), pa.float64(), pa.int32()]
    if not len(keys):
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names), rest
    b = np.flatnonzero(within % BLOCK == 0)
    n, row = np.diff(np.r_[b, len(keys)]), pa.array(firsts[term[b]])
    made = [runs.column(1).take(row), pa.array(n, pa.int32()), pa.array(keys[b]), pa.array(keys[b + n - 1]), _lists(np.delete(np.diff(keys), b[1:] - 1), n - 1, pa.int64()),
            _lists(tf, n, pa.int32()), _lists(lens, n, pa.int32()), _lists(places, np.add.reduceat(tf, b), pa.int32()), pa.array(np.maximum.reduceat(tf, b), pa.int32()),
            pa.array(np.minimum.reduceat(lens / tf, b)), runs.column(0).take(row)]
    return pa.RecordBatch.from_arrays(made, names=names), rest


def _read_back(base: pa.Array, gaps: pa.Array, tf: pa.Array, lens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of postings of each block, and the keys, tf and len of all postings of the blocks."""
    n = _lengths(tf)
    starts = np.cumsum(n) - n
    steps = np.zeros(int(n.sum()), dtype=np.int64)
    own = np.ones(len(steps), dtype=bool)
    own[starts] = False
    steps[own] = gaps.flatten().to_numpy()
    keys = np.cumsum(steps)
    keys += np.repeat(base.to_numpy() - keys[starts], n)
    return n, keys, tf.flatten().to_numpy(), lens.flatten().to_numpy()


@dataclass
class Index:
    """An index of ``parts``, each with the folder of its postings and their number of buckets; those that ``append`` wrote lie below ``path`` and
    have records and statistics beside them."""

    spark: SparkSession
    parts: list[dict]
    path: str | None = None

    @property
    def whole_records(self) -> DataFrame:
        """The records with their terms in order."""
        return self.spark.read.parquet(*[f"{self.path}/{p['name']}/records" for p in self.parts])

    @property
    def records(self) -> DataFrame:
        """The records' columns but for their terms."""
        return self.whole_records.drop("terms")

    def stats(self) -> DataFrame:
        """n_chunks and avgdl (one row), from one row for each part."""
        sums = self.spark.read.schema("n long, total long").parquet(*[f"{self.path}/{p['name']}/stats" for p in self.parts])
        return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("total") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avgdl"))

    def blocks(self, terms: DataFrame) -> DataFrame:
        """The blocks of ``terms`` (term): of the folders of these terms, while they can be named."""
        few = [r.term for r in terms.select("term").distinct().limit(TERMS + 1).collect()]
        if len(few) > TERMS:
            return self._read().join(terms.select("term").distinct(), "term", "left_semi")
        named = self.spark.createDataFrame([(t,) for t in few], "term string")
        return self._read(named).join(F.broadcast(named), "term", "left_semi")  # at most TERMS rows

    def _read(self, named: DataFrame | None = None) -> DataFrame:
        """All blocks, or those in the folders of the ``named`` terms."""
        frames, wanted = [], {}
        for p in self.parts:
            n, root = p["buckets"], f"{self.path}/{p['name']}/postings" if self.path else p["postings"]
            if n not in wanted:
                wanted[n] = range(n) if named is None else sorted(r.b for r in named.select(_bucket(n).alias("b")).distinct().collect())
            found = [f"{root}/bucket={b}" for b in wanted[n] if pointers.exists(self.spark, f"{root}/bucket={b}")]
            if found:
                frames.append(self.spark.read.schema(POSTINGS).option("basePath", root).parquet(*found))
        out = frames[0] if frames else self.spark.createDataFrame([], POSTINGS)
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def hits(self, terms: DataFrame, key: str = "doc_id") -> DataFrame:
        """key, len, pos, term: the places of ``terms``, written once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo, hi in _chunks(_lengths(whole.column(5)), PLACES):
                    batch = whole.slice(lo, hi - lo)
                    n, keys, tf, lens = _read_back(*batch.columns[1:5])
                    steps, begins = np.cumsum(batch.column(5).flatten().to_numpy(), dtype=np.int64), np.cumsum(tf, dtype=np.int64) - tf
                    pos = steps - np.repeat(np.where(begins > 0, steps[begins - 1], 0), tf)
                    own = np.repeat(np.repeat(np.arange(len(n)), n), tf)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(keys, tf)), pa.array(np.repeat(lens, tf), pa.int32()), pa.array(pos, pa.int32()), batch.column(0).take(pa.array(own))], names=[key, "len", "pos", "term"])

        blocks = self.blocks(terms).select("term", "base", "gaps", "tf", "len", "places")
        return written(blocks.mapInArrow(run, f"{key} long, len int, pos int, term string"), "hits")

    def weights(self, terms: DataFrame, blocks: DataFrame) -> DataFrame:
        """qid, term, df, weight, avgdl, most (a bound of the term's part) of query terms that the index has; from the blocks' heads alone."""
        wanted = terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
        heads = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_ratio").alias("min_ratio"))
        both = wanted.join(heads, "term").crossJoin(F.broadcast(self.stats()))  # one row
        n, avgdl = F.col("n_chunks"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return both.select("qid", "term", "df", (idf * F.col("times")).alias("weight"), avgdl.alias("avgdl"), "max_tf", "min_ratio").withColumn("most", bound())

    def doc_freq(self) -> DataFrame:
        """term, df of the whole index, from the blocks' heads."""
        return self._read().groupBy("term").agg(F.sum("n").alias("df"))

    def scores(self, terms: DataFrame, key: str = "doc_id") -> DataFrame:
        """qid, key, bm25 of all records that hold a query term; neither places nor other terms are read."""
        blocks = self.blocks(terms)
        weights = written(self.weights(terms, blocks).select("qid", "term", "weight", "avgdl"), "weights")
        return _parts(blocks.join(_small(weights), "term"), key).groupBy("qid", key).agg(F.sum("part").alias("bm25"))

    def topk(self, terms: DataFrame, k: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
        """qid, key, bm25, rank of the ``k`` best records of each query by BM25 (to nine digits, then by key); also the second pass's blocks, those read and all.

        First pass: each query's rarest terms (as many as are needed to have ``k`` records) are scored.  The k-th best sum is a threshold that
        the result reaches at least.  Second pass, over the blocks of the other terms: a block is read only if its bound with the bounds of
        the query's further terms reaches the threshold without the first terms, or if a record of the first pass that may still
        reach it (a candidate) lies between its first and last key.  What is skipped can't be in the result, so the result is exact.  Thresholds and candidates are
        broadcast; with more than ``CANDIDATES`` of them all blocks are read.
        """
        blocks = self.blocks(terms)
        weights = written(self.weights(terms, blocks), "weights")
        before = F.sum("df").over(Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        seeded = written(weights.withColumn("seed", F.coalesce(before, F.lit(0)) < k), "seeds")
        small = seeded.select("qid", "term", "weight", "avgdl", "most", "seed")
        first = written(_parts(blocks.join(_small(small.where("seed")), "term"), key).groupBy("qid", key).agg(F.sum("part").alias("part")), "first")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("part")))
        least = first.withColumn("r", rank).where(F.col("r") <= k).groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.min("part")).alias("least"))
        rest = small.where("not seed").groupBy("qid").agg(F.sum("most").alias("rest"))
        ends = written(least.join(rest, "qid").select("qid", F.coalesce("least", F.lit(0.0)).alias("least"), "rest"), "thresholds")
        candidates = first.join(_small(ends), "qid").where(F.col("part") + F.col("rest") >= F.col("least") - MARGIN).select("qid", key).limit(CANDIDATES + 1).collect()
        others = blocks.join(_small(small.where("not seed")), "term").join(_small(ends), "qid")
        kept = others.where((bound() + F.col("rest") - F.col("most") >= F.col("least") - MARGIN) | _covers(self.spark, candidates, key))
        sums = first.unionByName(_parts(kept, key)).groupBy("qid", key).agg(F.sum("part").alias("bm25"))
        order = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("bm25", 9).desc(), key))
        top = sums.withColumn("rank", order.cast("long")).where(F.col("rank") <= k)
        return top, kept, others


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (of the queries, written before) marked for a broadcast while there are at most ``TERMS``."""
    return F.broadcast(rows) if rows.limit(TERMS + 1).count() <= TERMS else rows


def bound():
    """What a posting of a block can add at most."""
    tf, b, k1 = F.col("max_tf"), ranking.B, ranking.K1
    return F.col("weight") * (k1 + 1) / (1 + k1 * (1 - b) / tf + k1 * b * F.col("min_ratio") / F.col("avgdl"))


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """qid, key, part: what each posting of blocks with a weight adds to its record's BM25."""
    kind, k1, b = rows.schema["qid"].dataType, ranking.K1, ranking.B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                n, keys, tf, lens = _read_back(*batch.columns[1:5])
                weight, avgdl = (np.repeat(batch.column(i).to_numpy(), n) for i in (5, 6))
                part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / avgdl))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(keys), pa.array(part)], names=["qid", key, "part"])

    return rows.select("qid", "base", "gaps", "tf", "len", "weight", "avgdl").mapInArrow(run, f"qid {kind.simpleString()}, {key} long, part double")


def _covers(spark: SparkSession, candidates: list, key: str):
    """Whether a candidate of the block's query lies between its first and last key."""
    if len(candidates) > CANDIDATES:
        return F.lit(True)
    keys: dict[int, np.ndarray] = {}
    for r in candidates:
        keys.setdefault(r.qid, []).append(r[key])
    shared = spark.sparkContext.broadcast({q: np.sort(np.array(x)) for q, x in keys.items()})

    @F.pandas_udf("boolean")
    def covers(qid, base, last):  # noqa: ANN001, ANN202
        import pandas as pd

        out = np.zeros(len(qid), dtype=bool)
        for q in qid.unique():
            own = (qid == q).to_numpy()
            if q in shared.value:
                x = shared.value[q]
                out[own] = np.searchsorted(x, base[own].to_numpy(), "left") < np.searchsorted(x, last[own].to_numpy(), "right")
        return pd.Series(out)

    return covers(F.col("qid"), F.col("base"), F.col("last"))


def write_postings(recs: DataFrame, path: str, n: int, key: str, buckets: int) -> None:
    """The blocks of ``n`` records (key, terms) in folders below ``path``."""
    slices = max(1, -(-n // SLICE))
    posts = _postings(recs, key, slices).withColumn("bucket", _bucket(buckets))
    dealt = posts.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "term", "base").select("bucket", "term", "keys", "tf", "len", "places")
    dealt.mapInArrow(_blocks, POSTINGS).write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The index below ``path``, if there is one."""
    found = pointers.latest(spark, path, "INDEX")
    return Index(spark, found["parts"], path) if found else None


def append(recs: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS) -> Index:
    """Add records (key, terms, len, further columns) to the index below ``path`` as one more part, and begin it if there is none.

    A part is written whole before the list of parts names it, so readers see it whole or not at all; there is one writer.
    """
    spark, name = recs.sparkSession, f"part-{uuid.uuid4().hex}"
    recs.write.parquet(f"{path}/{name}/records")
    own = spark.read.parquet(f"{path}/{name}/records")
    own.where("len > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).write.parquet(f"{path}/{name}/stats")
    write_postings(recs, f"{path}/{name}/postings", spark.read.parquet(f"{path}/{name}/stats").first().n, key, buckets)
    known = pointers.latest(spark, path, "INDEX") or {"parts": [], "number": 0}
    parts = [*known["parts"], {"name": name, "buckets": buckets}]
    pointers.publish(spark, path, "INDEX", {"parts": parts}, known["number"])
    return Index(spark, parts, path)
