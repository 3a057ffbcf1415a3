"""The stored index: parts, what is read, and the pruned top k against plain BM25."""

import collections
import datetime as dt
import math
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import batch, index, pointers, ranking


def _records(spark, n, begin=0, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    rows = []
    for i in range(begin, begin + n):
        terms = rng.choices(words, weights, k=rng.randint(1, 60))
        rows.append((i, terms, len(terms), f"s{i % 7}"))
    return spark.createDataFrame(rows, "doc_id long, terms array<string>, len int, source string")


def _terms(spark, queries):
    return spark.createDataFrame([(q, i, t) for q, ts in queries.items() for i, t in enumerate(ts.split())], "qid int, qpos int, term string")


QUERIES = {1: "w0 w150", 2: "w1 w2 w3", 3: "w199 w198 w0 w0", 4: "nowhere", 5: "w0", 6: "nowhere w120 w5"}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """An index of three parts, and all of its records."""
    parts = [_records(spark, 900), _records(spark, 600, 900, 2), _records(spark, 1, 1500, 3)]
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    for p in parts:
        own = index.append(p, path, buckets=8)
    return own, parts[0].unionByName(parts[1]).unionByName(parts[2])


def _plain(recs, terms):
    return ranking.bm25(ranking.hits(recs, terms), ranking.corpus_stats(recs), terms)


def test_places_and_statistics_over_parts(spark, both):
    own, recs = both
    terms = _terms(spark, QUERIES)
    for left, right in ((own.hits(terms), ranking.hits(recs, terms)), (own.doc_freq(), ranking.doc_freq(recs)), (own.stats(), ranking.corpus_stats(recs))):
        columns = sorted(left.columns)
        assert sorted(map(tuple, left.select(*columns).collect())) == sorted(map(tuple, right.select(*columns).collect()))
    assert own.records.count() == recs.count() and "terms" not in own.records.columns


@pytest.mark.parametrize("k", [1, 8, 5000])
def test_pruned_top_k_is_exact(spark, both, k):
    own, recs = both
    terms = _terms(spark, QUERIES)
    scores = {}
    for r in _plain(recs, terms).collect():
        scores.setdefault(r.qid, []).append((-round(r.bm25, 9), r.doc_id))
    want = sorted((q, d, i + 1) for q, x in scores.items() for i, (_, d) in enumerate(sorted(x)[:k]))
    top, read, of = own.topk(terms, k)
    assert sorted((r.qid, r.doc_id, r["rank"]) for r in top.collect()) == want
    assert read.count() <= of.count()


def test_blocks_are_skipped(spark, tmp_path):
    """A rare word decides: of a common word's blocks, those that hold none of its records aren't read."""
    rows = [(i, ["common"] * (1 + i % 3) + ["filler"] * 5 + (["rare"] * 3 if i in (7, 5000) else []), 9, "s") for i in range(6000)]
    own = index.append(spark.createDataFrame(rows, "doc_id long, terms array<string>, len int, source string"), f"file://{tmp_path}/i", buckets=4)
    top, read, of = own.topk(_terms(spark, {1: "rare common"}), 2)
    assert sorted(r.doc_id for r in top.collect()) == [7, 5000]
    assert (read.count(), of.count()) == (2, 47)


def test_many_candidates_and_terms_read_all(spark, both, monkeypatch):
    own, recs = both
    terms = _terms(spark, QUERIES)
    want = sorted((r.qid, r.doc_id) for r in own.topk(terms, 8)[0].collect())
    monkeypatch.setattr(index, "CANDIDATES", 0)
    monkeypatch.setattr(index, "TERMS", 1)
    assert sorted((r.qid, r.doc_id) for r in own.topk(terms, 8)[0].collect()) == want


def test_only_the_folders_of_the_terms_are_read(spark, both):
    own, _ = both
    terms = _terms(spark, {1: "w7"})
    bucket = terms.select(index._bucket(8)).first()[0]
    files = own.blocks(terms).inputFiles()
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    every = own._read().inputFiles()
    assert len(files) < len(every) / 2
    plan = own.scores(terms)._jdf.queryExecution().toString()
    assert "places" not in plan.split("== Physical Plan ==")[1]


def test_slices_split_a_term(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SLICE", 100)
    recs = _records(spark, 500)
    own, terms = index.append(recs, f"file://{tmp_path}/i", buckets=2), _terms(spark, QUERIES)
    assert own.blocks(_terms(spark, {1: "w0"})).count() >= 5
    got, want = (sorted((r.qid, r.doc_id, round(r.bm25, 9)) for r in x.collect()) for x in (own.scores(terms), _plain(recs, terms)))
    assert got == want


def test_an_index_of_nothing(spark, tmp_path):
    assert index.open_index(spark, f"file://{tmp_path}/i") is None
    own = index.append(_records(spark, 3).limit(0), f"file://{tmp_path}/i")
    terms = _terms(spark, QUERIES)
    assert own.hits(terms).count() == own.scores(terms).count() == own.topk(terms, 3)[0].count() == 0
    assert own.stats().first() == (0, 0.0)
    more = index.append(_records(spark, 5).unionByName(spark.createDataFrame([(99, [], 0, "s"), (98, None, 0, None)], "doc_id long, terms array<string>, len int, source string")), own.path)
    assert more.stats().first().n_chunks == 5 and more.records.count() == 7


def test_pointers(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    assert pointers.latest(spark, path, "P") is None
    assert pointers.publish(spark, path, "P", {"a": 1}) == 1 and pointers.publish(spark, path, "P", {"a": 2}, 1) == 2
    with pytest.raises(RuntimeError, match="another writer"):
        pointers.publish(spark, path, "P", {"a": 3}, 1)
    (tmp_path / "p" / "_P-draft").write_text("a writer died here")
    assert pointers.latest(spark, path, "P") == {"a": 2, "number": 2}
    for i in range(3):
        pointers.publish(spark, path, "P", {"a": i})
    pointers.forget(spark, path, "P")
    assert pointers.latest(spark, path, "P") == {"a": 2, "number": 5}


def test_the_build_deals_runs_and_reads_back_in_pieces(spark, monkeypatch):
    """What is dealt out is a row for each term of what a task holds, not for each posting; places are read back a bounded piece at a time."""
    recs = _records(spark, 600).coalesce(1)
    runs = index._postings(recs, "doc_id", 1)
    assert runs.count() <= 200 < ranking.postings(recs).count() / 10
    batches = runs.withColumn("bucket", F.lit(0)).orderBy("term", "base").select("bucket", "term", "keys", "tf", "len", "places").toArrow().to_batches()
    monkeypatch.setattr(index, "TOKENS", 50)
    blocks = [b for given in batches for b in index._blocks(iter([given.slice(i, 1) for i in range(given.num_rows)]))]
    found = {}
    for b in blocks:
        n, keys, tf, lens = index._read_back(b.column(2), b.column(4), b.column(5), b.column(6))
        for t, k, f in zip(np.repeat(b.column(0).to_pylist(), n), keys, tf, strict=True):
            found[t, k] = f
        assert not len(n) or n.max() <= index.BLOCK
    assert found == {(r.term, r.doc_id): r.tf for r in ranking.postings(recs).collect()}


def test_many_queries_in_arrays_as_few_from_postings(spark, tmp_path, monkeypatch):
    """The same rows both ways: phrases, places, repeated and unknown terms, equal records, blocks of queries and pieces of records."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(400):
        text = " ".join(rng.choices(words, [1 / (j + 1) for j in range(30)], k=rng.randint(1, 40))) if i % 7 else "w3 w9 w4 w4 w20"
        rows.append((i, text, f"s{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 90)))
    chunks = spark.createDataFrame(rows, "doc_id long, text string, source string, when_ts timestamp").withColumns({"at": F.col("when_ts"), "seq": F.col("doc_id")})
    own = index.append(ranking.records(chunks, carry=("source", "when_ts", "at", "seq")), f"file://{tmp_path}/i", buckets=4)
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for q in range(20)] + [(90, "w3 w9 w4 w4 w20"), (91, "nowhere"), (92, "w4 nowhere w9"), (93, "w1 w1")]
    asked = spark.createDataFrame(asked, "qid long, query string")
    now = F.lit("2024-12-31").cast("timestamp")
    monkeypatch.setattr(batch, "QUERIES", 9)
    monkeypatch.setattr(batch, "WORK", 2_000)
    monkeypatch.setattr(ranking, "FEW_QUERIES", 99)
    few = ranking.recall(own.records, asked, now, index=own, whole=True)
    monkeypatch.setattr(ranking, "FEW_QUERIES", 0)
    many = ranking.recall(own.records, asked, now, index=own, whole=True)
    want, got = (sorted((r.qid, r["rank"], r.doc_id, r.score) for r in x.collect()) for x in (few, many))
    assert got == want and len(got) == 23 * 8
    assert "Join" not in batch._best(own.whole_records.withColumn("recency", F.lit(1.0)), None, "doc_id", 8, {})._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def _one_by_one(codes, query, phrase, kinds, bm25):
    """The boosted score of one record, hit after hit."""
    latest, best = {}, (0, 0)
    at = [i for i, c in enumerate(codes) if c in query]
    for pos in at:
        latest.pop(codes[pos], None)
        latest[codes[pos]] = pos
        best = min(best, (-len(latest), pos - next(iter(latest.values()))))
    have, span = -best[0], best[1]
    close = have / kinds * (have - 1) / span if have >= 2 and kinds >= 2 else 0.0
    whole = kinds > 1 and have == kinds and any(codes[i:i + len(phrase)] == phrase for i in at)
    return bm25 * (1 + ranking.PROXIMITY_BOOST * close + (ranking.PHRASE_BOOST if whole else 0.0))


@pytest.mark.parametrize("often", [0, 1 / 20, 2])
def test_places_of_many_pairs_at_once(monkeypatch, often):
    """Scores of all pairs equal those taken hit by hit; bounds from first and last places lie above them, and leave few pairs whose places are gone through."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    queries = [rng.choices(words, weights, k=rng.randint(1, 12)) for _ in range(25)] + [["w1"], ["w2", "w2"], ["w0", "nowhere"], ["w5", "w1", "w5", "w7"]]
    texts = [rng.choices(words, weights, k=rng.randint(1, 150)) for _ in range(300)] + [[], ["w5", "w1", "w5", "w7"], ["w9", "w5", "w1", "w5", "w7", "w5"], ["w5", "w1", "w7", "w5"]]
    term = collections.namedtuple("Term", "qpos term")
    rows = [types.SimpleNamespace(qid=i, terms=[term(p, t) for p, t in enumerate(q)]) for i, q in enumerate(queries)]
    block = batch.Block(rows, collections.Counter(t for x in texts for t in {*x} & {t for q in queries for t in q}), len(texts), 70.0)
    monkeypatch.setattr(batch, "WORK", 4_000)
    monkeypatch.setattr(batch, "OFTEN", often)
    own = batch.Records(batch.packed(pa.array([["w1"], *texts], pa.list_(pa.string())), pa.array(block.words)).slice(1), block)
    doc, query, near, most = [], [], [], []
    for lo, scores, bounds in own.pieces():
        d, q = np.nonzero(scores)
        doc, query, near, most = np.r_[doc, d + lo].astype(int), np.r_[query, q].astype(int), np.r_[near, scores[d, q]], np.r_[most, bounds[d, q]]
    got, bound = own.lexical(doc, query), own.bound(doc, query)
    code, df = {w: c for c, w in enumerate(block.words)}, collections.Counter(t for x in texts for t in {*x})
    assert sorted(zip(doc.tolist(), query.tolist(), strict=True)) == [(d, q) for d, x in enumerate(texts) for q, y in enumerate(queries) if {*x} & {*y}]
    coded, bm25 = [[code.get(t, -1) for t in x] for x in texts], []
    for d, q in zip(doc, query, strict=True):
        tf = collections.Counter(texts[d])
        below = 1.5 * (0.25 + 0.75 * len(texts[d]) / 70)
        bm25.append(sum(math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + below) for t in queries[q] if tf[t]))
    want = [_one_by_one(coded[d], {code[t] for t in queries[q] if t in code}, block.phrases[q], int(block.kinds[q]), s) for d, q, s in zip(doc, query, bm25, strict=True)]
    assert got == pytest.approx(want, rel=1e-12) and (got > 2 * np.array(bm25)).sum() >= 3
    assert near == pytest.approx(bm25, rel=block.rounded) and (got <= bound).all() and (bound * (1 - block.rounded) <= most).all()
    top = np.zeros(len(rows))
    np.maximum.at(top, query, got)
    assert (bound >= top[query]).sum() < (most >= top[query]).sum() / 4
