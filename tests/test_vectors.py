"""The stored vector index: exact against all rows, and what it reads."""

import re

import numpy as np
import pytest

from mnemospark.operators import ranking, vectors

SCHEMA = "vec_id long, embedding array<float>"


def _rows(spark, n, begin=0, seed=3, hot=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(1).normal(size=(12, 8))
    rows = [(begin + i, (middles[0 if i < hot else i % 12] + rng.normal(size=8) * 0.1).astype(float).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _odd(spark):
    same = [0.5] * 8
    return spark.createDataFrame([(9000, None), (9001, []), (9002, [0.0] * 8), (9003, [1.0, 2.0, 3.0]), (9004, same), (9005, same), (9005, same), (None, same)], SCHEMA)


def _plain(rows, queries, k):
    """The k nearest by cosine to nine digits, then by key, one row at a time."""
    cos = lambda a, b: round(max(0.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))), 9) if b is not None and len(a) == len(b) and any(a) and any(b) else 0.0
    out = []
    for q in queries:
        if q.embedding is not None:
            best = sorted((-cos(q.embedding, r.embedding), r.vec_id is None, r.vec_id or 0) for r in rows)[:k]
            out += [(q.vec_id, None if none else key, -c, i) for i, (c, none, key) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("k", [1, 10, 700])
def test_exact_over_parts(spark, tmp_path, k):
    path = f"file://{tmp_path}/v"
    parts = [_rows(spark, 400), _rows(spark, 200, 400, seed=5, hot=150), _odd(spark)]
    for p in parts:
        own = vectors.append(p, path, "vec_id", cells=12)
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    queries = everything.where("vec_id % 50 = 0 or vec_id > 8999")
    got = sorted((r.q, r.rank, r.vec_id, r.cosine) for r in vectors.nearest(vectors.open_vectors(spark, path), queries, k, "vec_id").collect())
    want = sorted((q, rank, key, c) for q, key, c, rank in _plain(everything.collect(), queries.collect(), k))
    pick = lambda rows: [(q, rank) for q, rank, *_ in rows]
    assert pick(got) == pick(want) and np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-9)
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.999 * len(want)  # a last digit may decide otherwise
    assert sum(own.cells()[0].values()) == 608


def test_few_cells_are_read(spark, tmp_path):
    own = vectors.append(_rows(spark, 600), f"file://{tmp_path}/v", "vec_id", cells=12)
    read = []
    rows = own.rows
    own.rows = lambda cells: (read.append(cells), rows(cells))[1]
    vectors.nearest(own, _rows(spark, 1), 5, "vec_id").collect()
    assert len({c for cells in read for c in cells}) <= 3 and len(own.cells()[0]) >= 8
    assert re.search(r"PartitionFilters: \[[^\]]*cell", rows([1])._jdf.queryExecution().toString())


def test_nothing_stored_or_asked(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    with pytest.raises(FileNotFoundError):
        vectors.open_vectors(spark, path)
    own = vectors.append(_rows(spark, 1).limit(0), path, "vec_id")
    assert vectors.nearest(own, _rows(spark, 1), 3, "vec_id").collect() == []
    own = vectors.append(_rows(spark, 5), path, "vec_id")
    assert len(own.centroids) and vectors.nearest(own, _rows(spark, 1), 3, "vec_id").count() == 3
    assert vectors.nearest(own, _rows(spark, 1).limit(0), 3, "vec_id").collect() == []


def test_as_the_plain_search(spark, tmp_path):
    rows = _rows(spark, 300)
    own = vectors.append(rows, f"file://{tmp_path}/v", "vec_id")
    asked = rows.where("vec_id < 20")
    assert {(r.q, r.rank, r.vec_id) for r in vectors.nearest(own, asked, 5, "vec_id").collect()} == {
        (r.q, r.rank, r.vec_id) for r in ranking.nearest(asked, rows, 5, "vec_id").collect()}


def test_rows_are_compared_a_bounded_number_at_a_time(spark, tmp_path, monkeypatch):
    """Pieces of any size give the same rows, and no array of a task has more rows than a piece."""
    rows = _rows(spark, 700)
    path = f"file://{tmp_path}/v"
    vectors.append(rows, path, "vec_id", cells=3)
    asked = rows.where("vec_id % 20 = 0")
    both = lambda: [sorted(map(tuple, x.select("q", "rank", "vec_id").collect())) for x in (ranking.nearest(asked, rows, 5, "vec_id"), vectors.nearest(vectors.open_vectors(spark, path), asked, 5, "vec_id"))]
    want = both()
    monkeypatch.setattr(ranking, "ROWS", 7)
    given = spark.range(100).coalesce(1).toArrow().to_batches()
    assert [p.num_rows for p in ranking.pieces(iter(given))] == [7] * 14 + [2]
    assert both() == want
