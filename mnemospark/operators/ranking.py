"""Ranking: records, postings, corpus statistics, BM25, proximity, phrases, recency, cosine, feedback and the composed recall.

All take many queries at once, keyed by ``qid``.  Texts are tokenized once, into records (key, terms, len); everything else
comes from the records' ``len`` and from the hits: the places of query terms, a small table that is written once.  Statistics
are those of the records as given, so a time window changes them.  Texts are joined back for the rows that are left.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemospark.functions import text as T
from mnemospark.functions import time as D
from mnemospark.functions.terms import tokenized
from mnemospark.operators.scratch import written

if TYPE_CHECKING:
    from mnemospark.operators.index import Index

K1, B = 1.5, 0.75
PHRASE_BOOST, PROXIMITY_BOOST = 1.0, 0.6
WEIGHTS = {"lexical": 0.8, "semantic": 0.0, "time": 0.2}
SEMANTIC_WEIGHTS = {"lexical": 0.45, "semantic": 0.45, "time": 0.1}
GATE = 0.2
#: Query terms that are broadcast to the records; more of them are joined.
MOST_TERMS = 200_000
#: Queries of a recall that are answered from the postings of their terms.
FEW_QUERIES = 16


def records(chunks: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, ``carry``, terms, len of the chunks that have a token; the others are never stored, so they don't count anywhere."""
    made = tokenized(chunks.select(key, *carry, F.col(text)), text)
    return written(made.withColumn("len", F.size("terms")).where("len > 0"), "records")


def postings(recs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf: term frequencies."""
    return recs.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(recs: DataFrame) -> DataFrame:
    """term, df: records that have a term; no row of a record leaves its task before it is counted."""
    return recs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(recs: DataFrame) -> DataFrame:
    """n_chunks and avgdl (one row)."""
    return recs.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, qpos, term of queries (qid, query); repeated terms stay."""
    return T.stemmed(queries.select("qid", F.posexplode(T.words(F.col("query"))).alias("qpos", "word")), "word", "term").drop("word")


def hits(recs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, len, pos, term: the places of query terms, written once."""
    each = recs.select(key, "len", F.posexplode("terms").alias("pos", "term"))
    wanted = written(terms.select("term").distinct(), "wanted")
    if wanted.count() <= MOST_TERMS:
        wanted = F.broadcast(wanted)  # at most MOST_TERMS rows
    return written(each.join(wanted, "term").select(key, "len", "pos", "term"), "hits")


def bm25(found: DataFrame, stats: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, key, bm25 of the records that hold a query term, from ``hits`` and ``corpus_stats``."""
    wanted = terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    tf = found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, avgdl = F.col("n_chunks"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", (idf * F.col("times")).alias("weight"), avgdl.alias("avgdl"))  # stats: one row
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return tf.join(weights, "term").groupBy("qid", key).agg(F.sum(part).alias("bm25"))


def proximity(found: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, key, proximity: share of the query's distinct terms present, by how close together they stand.

    One pass over each record's hits in order: every hit ends a window that reaches back to the latest place of each
    term so far.  The terms stand in the order of those places, so the window's start is the first of them.
    """
    distinct = terms.select("qid", "term").distinct()
    size = distinct.groupBy("qid").agg(F.count(F.lit(1)).alias("q"))
    rows = found.join(distinct, "term").select("qid", key, "pos", "term")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("qid", key).schema) + ", have int, span int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, latest, best = None, {}, (0, 0)
        for batch in batches:
            done: list[tuple] = []
            for qid, own, pos, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (qid, own) != now:
                    if now is not None:
                        done.append((*now, -best[0], best[1]))
                    now, latest, best = (qid, own), {}, (0, 0)
                latest.pop(term, None)
                latest[term] = pos
                best = min(best, (-len(latest), pos - next(iter(latest.values()))))
            yield record(done)
        if now is not None:
            yield record([(*now, -best[0], best[1])])

    types = [to_arrow_type(f.dataType) for f in rows.select("qid", key).schema] + [pa.int32()] * 2

    def record(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["qid", key, "have", "span"])

    spans = rows.repartition("qid", key).sortWithinPartitions("qid", key, "pos").mapInArrow(run, schema).join(size, "qid")
    score = F.when((F.col("have") >= 2) & (F.col("q") >= 2), F.col("have") / F.col("q") * (F.col("have") - 1) / F.col("span")).otherwise(0.0)
    return spans.select("qid", key, score.alias("proximity"))


def phrases(found: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, key of records in which all of a query's terms stand in a row."""
    n = terms.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("kinds")).where("kinds > 1")
    rows = found.join(terms, "term").groupBy("qid", key, (F.col("pos") - F.col("qpos")).alias("start")).agg(F.count_distinct("qpos").alias("c"))
    return rows.join(n, "qid").where("c = n").select("qid", key).distinct()


def of_records(found: DataFrame, recs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``hits`` of an index that are in ``recs``, of which the keys alone are read."""
    keys = written(found.select(key).distinct(), "found")
    few = keys.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    own = recs.select(key).join(F.broadcast(keys) if few else keys, key, "left_semi")
    return written(found.join(F.broadcast(own) if few else own, key, "left_semi").select(*found.columns), "hits")


def lexical(recs: DataFrame, terms: DataFrame, key: str = "doc_id", index: Index | None = None, whole: bool = False) -> DataFrame:
    """qid, key, lexical: boosted BM25 of the records that hold a query term.

    A stored ``index`` of these and possibly more records serves for their terms, which ``recs`` needn't have then; ``whole``: it has no more.
    """
    if index is None:
        found, stats = hits(recs, terms, key), corpus_stats(recs)
    elif whole:
        found, stats = index.hits(terms, key), index.stats()
    else:
        found, stats = of_records(index.hits(terms, key), recs, key), corpus_stats(recs)
    return boosted(bm25(found, stats, terms, key), proximity(found, terms, key), phrases(found, terms, key), key)


def boosted(scores: DataFrame, prox: DataFrame, phrase: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, key, lexical: BM25 times the proximity and phrase boosts."""
    both = scores.join(prox, ["qid", key], "left").join(phrase.withColumn("phrase", F.lit(1)), ["qid", key], "left")
    boost = 1 + PROXIMITY_BOOST * F.coalesce("proximity", F.lit(0.0)) + F.when(F.col("phrase") == 1, PHRASE_BOOST).otherwise(0.0)
    return both.select("qid", key, (F.col("bm25") * boost).alias("lexical"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a null, a difference in length or a zero vector, and never below 0."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    same = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b))
    return F.when(same, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))).otherwise(0.0)


#: Query vectors that go to every task at once, and rows that a task compares with them at once.
VECTORS, ROWS = 4096, 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ``ROWS`` rows at a time: what is held for each query and row is bounded, whatever the batches are."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """q, key, cosine, rank: the ``k`` nearest rows of each query by cosine (to nine digits, then by key).

    Queries go through in blocks of ``VECTORS``, each read and broadcast in turn; a task keeps the ``k`` best of its own rows for
    each query, so what is shuffled doesn't grow with the rows.  Vectors of other lengths, or of length 0, are at cosine 0.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    asked = queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator()
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "key"))
    found: list[DataFrame] = []
    while block := list(itertools.islice(asked, VECTORS)):
        shared = spark.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors = [a for a, _ in shared.value], [np.array(v, dtype=np.float64) for _, v in shared.value]
            unit = lambda v: v / n if (n := np.linalg.norm(v)) else v
            tables = {n: ([i for i, v in enumerate(vectors) if len(v) == n], np.array([unit(v) for v in vectors if len(v) == n])) for n in {len(v) for v in vectors}}
            best, least = [[] for _ in names], np.full(len(names), -1.0)
            for batch in pieces(batches):
                keys = batch.column(0).to_pylist()
                own = [np.array([] if v is None else v, dtype=np.float64) for v in batch.column(1).to_pylist()]
                scores = np.zeros((len(names), len(own)))
                for n, (at, table) in tables.items():
                    if same := [i for i, v in enumerate(own) if len(v) == n]:
                        scores[np.ix_(at, same)] = np.round(np.maximum(0, table @ np.array([unit(own[i]) for i in same]).T), 9)
                few = min(k, len(own))
                for q in np.flatnonzero(scores.max(axis=1) >= least).tolist():
                    row = scores[q]
                    at = np.flatnonzero(row >= max(least[q], np.partition(row, -few)[-few]))
                    best[q] = sorted(best[q] + [(-row[i], keys[i]) for i in at])[:k]
                    if len(best[q]) == k:
                        least[q] = -best[q][-1][0]
            out = [(names[q], y, -x) for q in range(len(names)) for x, y in best[q]]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], types[i]) for i in (0, 1)], pa.array([r[2] for r in out], pa.float64())], names=["q", "key", "cosine"])

        types = [to_arrow_type(rows.schema[key].dataType)] * 2
        part = rows.select(key, vector).mapInArrow(run, f"q {kind}, key {kind}, cosine double")
        found.append(written(part.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k), "nearest"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], f"q {kind}, {key} {kind}, cosine double, rank long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("key", key)


#: Queries and feedback entries that one task compares, and numbers that it holds for them at once.
BLOCK_QUERIES, BLOCK_ENTRIES, CELLS = 2_048, 16_384, 4_000_000


def _block(count: int, size: int, *columns: str) -> Column:
    """The block of a row, of about ``size`` rows each."""
    return F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-count // size)))).cast("int")


def _gathered(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each of the slices, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


def bonus(terms: DataFrame, feedback: DataFrame) -> DataFrame:
    """qid, source, bonus from feedback (terms, source, count): the best entry that shares half of its terms with the query.

    Queries and entries are dealt into blocks, and each pair of blocks is a unit of work, which counts the shared terms of all its
    pairs in arrays; what is shuffled is each entry once for every block of queries, and never a row for each pair.
    """
    asked = written(terms.where("term is not null").groupBy("qid").agg(F.collect_set("term").alias("q")), "asked")
    weight = F.least(F.lit(0.3), 0.1 + 0.05 * F.log1p("count")).alias("weight")
    entries = written(feedback.where(F.size("terms") > 0).select("terms", "source", weight), "entries")
    n_asked, n_entries = asked.count(), entries.count()
    q_blocks, e_blocks = max(1, -(-n_asked // BLOCK_QUERIES)), max(1, -(-n_entries // BLOCK_ENTRIES))
    unit = lambda q, e: (q * F.lit(e_blocks) + e).alias("unit")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("own", _block(n_asked, BLOCK_QUERIES, "qid")).withColumn("other", each(e_blocks)).select(unit(F.col("own"), F.col("other")), "qid", "q")
    right = entries.withColumn("own", _block(n_entries, BLOCK_ENTRIES, "terms", "source")).withColumn("other", each(q_blocks))
    right = right.select(unit(F.col("other"), F.col("own")), "terms", "source", "weight")
    kind = to_arrow_type(asked.schema["qid"].dataType)

    def run(queries: pa.Table, given: pa.Table) -> pa.Table:
        nothing = pa.table({"qid": pa.array([], kind), "source": pa.array([], pa.string()), "bonus": pa.array([], pa.float64())})
        if not queries.num_rows or not given.num_rows:
            return nothing
        lists = queries.column("q").combine_chunks()
        words = lists.flatten().dictionary_encode()
        code, who = words.indices.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(code, kind="stable")
        who, df = who[order], np.bincount(code, minlength=len(words.dictionary))
        begins = np.cumsum(df) - df
        lists, n_q = given.column("terms").combine_chunks(), queries.num_rows
        size = np.diff(lists.offsets.to_numpy())
        own = pc.fill_null(pc.index_in(lists.flatten(), words.dictionary), -1).to_numpy()
        entry = np.repeat(np.arange(len(lists)), size)
        # a term that an entry repeats is shared once
        both = np.unique(entry[own >= 0] * np.int64(len(df)) + own[own >= 0])
        entry, own = both // len(df), both % len(df)
        weight, source = given.column("weight").to_numpy(), given.column("source").combine_chunks().dictionary_encode()
        kinds = pc.fill_null(source.indices, len(source.dictionary)).to_numpy().astype(np.int64)
        best = np.zeros((len(source.dictionary) + 1, n_q))
        found = np.zeros(best.shape, dtype=bool)
        lo, work = 0, np.cumsum(np.bincount(entry, weights=df[own], minlength=len(lists)) + n_q)
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CELLS, "right")))
            i, j = np.searchsorted(entry, [lo, hi])
            sizes = df[own[i:j]]
            pairs = np.repeat((entry[i:j] - lo) * n_q, sizes) + who[_gathered(begins[own[i:j]], sizes)]
            shared = np.bincount(pairs, minlength=(hi - lo) * n_q).reshape(hi - lo, n_q)
            e, q = np.nonzero((shared > 0) & (2 * shared >= size[lo:hi, None]))
            at = kinds[lo + e], q
            np.maximum.at(best, at, shared[e, q] / size[lo + e] * weight[lo + e])
            found[at] = True
            lo = hi
        s, q = np.nonzero(found)
        names = pa.concat_arrays([source.dictionary, pa.nulls(1, source.dictionary.type)]).cast(pa.string())
        return pa.table({"qid": queries.column("qid").take(pa.array(q)), "source": names.take(pa.array(s)), "bonus": best[s, q]})

    pairs = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(run, f"qid {asked.schema['qid'].dataType.simpleString()}, source string, bonus double")
    return pairs.groupBy("qid", "source").agg(F.max("bonus").alias("bonus"))


def hybrid(scores: DataFrame, recs: DataFrame, now: Column, k: int = 8, semantic: DataFrame | None = None, feedback: DataFrame | None = None,
           key: str = "doc_id", weights: dict[str, float] | None = None, half_life_days: float = D.HALF_LIFE_DAYS) -> DataFrame:
    """qid, rank, key, score: the ``k`` best records (key, seq, when_ts, source) of each query.

    The maxima of the queries are aggregated (partial sums, one row for each query) and joined back; the top ``k`` goes through a
    ranked window whose limit is applied before its shuffle.  ``semantic`` has qid, key, cosine; ``feedback`` qid, source, bonus.
    """
    if semantic is not None:
        scores = scores.join(semantic, ["qid", key], "full")
    else:
        scores = scores.withColumn("cosine", F.lit(0.0))
    scores = scores.select("qid", key, F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))
    best = scores.groupBy("qid").agg(F.max("lexical").alias("top_lex"), F.max("cosine").alias("top_sem"))
    w = weights or (SEMANTIC_WEIGHTS if semantic is not None else WEIGHTS)
    norm = lambda c, top: F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(0.0)
    scores = scores.join(best, "qid").withColumns({"lex": norm("lexical", "top_lex"), "sem": norm("cosine", "top_sem")})
    gate = (F.col("lexical") > 0) | (F.col("cosine") > GATE)
    if semantic is not None:
        gate = gate | (F.col("sem") > GATE)
    rows = scores.where(gate).join(recs.select(*dict.fromkeys((key, "seq", "when_ts", *(["source"] if feedback is not None else [])))), key)
    extra = F.lit(0.0)
    if feedback is not None:
        rows, extra = rows.join(feedback, ["qid", "source"], "left"), F.coalesce("bonus", F.lit(0.0))
    score = w["lexical"] * F.col("lex") + w["semantic"] * F.col("sem") + w["time"] * D.recency(F.col("when_ts"), now, half_life_days) + extra
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("raw"), "seq"))
    return rows.withColumn("raw", score).withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", key, F.round("raw", 4).alias("score"))


def within(rows: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The rows whose ``at`` (their time, else that of their file) lies in the window, both ends included; a plain column, so the filter reaches the scan."""
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    return rows if until is None else rows.where(F.col("at") <= until)


def limit_of(limit: float | None, default: int = 8) -> int:
    """A number of results: rounded down, at least 1; missing, not finite, zero and negative ones give the default."""
    if not isinstance(limit, (int, float)) or isinstance(limit, bool) or limit != limit or limit in (float("inf"), float("-inf")) or limit <= 0:
        return default
    return max(1, int(limit))


def recall(recs: DataFrame, queries: DataFrame, now: Column, k: int = 8, since: Column | None = None, until: Column | None = None,
           semantic: DataFrame | None = None, feedback: DataFrame | None = None, key: str = "doc_id", weights: dict[str, float] | None = None,
           half_life_days: float = D.HALF_LIFE_DAYS, index: Index | None = None, whole: bool = False) -> DataFrame:
    """qid, rank, key, score for queries (qid, query) over records (key, seq, at, when_ts, source, terms, len) within the window.

    ``index`` and ``whole`` (for searches without a window) as for ``lexical``.  More than ``FEW_QUERIES`` queries of a whole index, or of records
    without one, are compared with the records in arrays (``batch``), since a row for each hit of each query grows with the product of both.
    """
    seen, terms = within(recs, since, until), query_terms(queries)
    whole = whole and since is None and until is None
    if (index is None or whole) and semantic is None and feedback is None and queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        from mnemospark.operators import batch

        return batch.recall(seen if index is None else index.whole_records, written(terms, "asked"), now, k, key, weights or WEIGHTS, half_life_days)
    extra = bonus(terms, feedback) if feedback is not None else None
    return hybrid(lexical(seen, terms, key, index, whole), seen, now, k, semantic, extra, key, weights, half_life_days)


def results(top: DataFrame, chunks: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``recall`` with source, lines, date, citation, snippet and text of their chunks, joined for the few rows that are left."""
    terms = query_terms(queries).groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    rows = chunks.select(key, "source", "start_line", "end_line", "when_ts", "date", "text").join(F.broadcast(top), key).join(terms, "qid", "left")  # top: k rows a query
    return rows.select(
        "qid", "rank", key, "score", "source", F.array("start_line", "end_line").alias("lines"), "when_ts", "date", T.citation(F.col("source"), F.col("start_line"), F.col("end_line")).alias("citation"),
        T.snippet(F.col("text"), F.coalesce("terms", F.array().cast("array<string>"))).alias("snippet"), "text")
