"""A stored vector index: rows lie in folders by their nearest centroid, and the exact top k is read from as few of them as a bound allows.

The centroids are fitted on a sample of at most ``2 * SAMPLE`` rows, picked by the hash of the key; every row is stored.  With each
cell goes the smallest cosine of a row to its centroid.  A row at an angle of at most r from a centroid that is t from the query is at least t - r from
the query, so cos(t - r) bounds the cell.  A query reads the cells nearest to it, until they have k rows; its k-th cosine
then tells which of the others could have a better one, and those are read too.  The result is exact, whatever the centroids;
they decide how much is read.

Vectors without a direction (null, empty, zero) and those of another length than the centroids lie in cell -1, which every query reads.
An empty table gives an index without cells, to which rows can be appended; rows with the same key are rows of their own.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import pointers
from mnemospark.operators.ranking import VECTORS, pieces
from mnemospark.operators.scratch import written

SAMPLE = 20_000
MOST_CELLS = 1_024
ROUNDS = 8
ROWS_PER_FILE = 500_000
NAME = "VECTORS"
#: Slack of the bounds against rounding.
SLACK = 1e-6


def _units(vectors: list, length: int) -> np.ndarray:
    """The vectors, all of ``length``, at length 1; zero vectors stay."""
    out = np.array(vectors, dtype=np.float64).reshape(-1, length)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def fitted(rows: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of the sample's most frequent length; about the square root of the rows' number, MOST_CELLS at most."""
    rows = rows.where(F.size(vector) > 0).select(key, vector)
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(sample / total * (1 << 31))).limit(2 * sample)
    found = [r[0] for r in rows.select(vector).collect() if None not in r[0]]
    length = np.bincount([len(v) for v in found] or [0]).argmax()
    points = _units([v for v in found if len(v) == length], length)
    points = points[np.isfinite(points).all(axis=1) & points.any(axis=1)]
    rng = np.random.Generator(np.random.PCG64(7))
    out = points[rng.permutation(len(points))[:min(cells or max(1, int(total ** 0.5)), MOST_CELLS)]]
    for _ in range(ROUNDS):
        own = np.argmax(points @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        out = np.where(sums.any(axis=1, keepdims=True), _units(sums, length), out)
    return out


def _assigned(rows: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """key, vector, cell, near (the cosine to the cell's centroid)."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            vectors = batch.column(1).to_pylist()
            cell, near = np.full(len(vectors), -1), np.zeros(len(vectors))
            if at := [i for i, v in enumerate(vectors) if len(own) and v is not None and len(v) == own.shape[1] and None not in v]:
                units = _units([vectors[i] for i in at], own.shape[1])
                with np.errstate(invalid="ignore"):
                    cosines = units @ own.T
                good = units.any(axis=1) & np.isfinite(cosines).all(axis=1)
                best = np.argmax(np.where(good[:, None], cosines, 0), axis=1)
                cell[at] = np.where(good, best, -1)
                near[at] = np.where(good, cosines[np.arange(len(at)), best], 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(near)], names=["key", "vector", "cell", "near"])

    picked = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return picked.mapInArrow(run, f"key {kind}, vector {rows.schema[vector].dataType.simpleString()}, cell int, near double")


@dataclass
class Vectors:
    spark: SparkSession
    path: str
    parts: list[dict]
    centroids: np.ndarray

    def rows(self, cells: list[int]) -> DataFrame:
        """key, vector, cell of the cells: of other cells no file is read."""
        out = [self.spark.read.parquet(f"{self.path}/{p['folder']}").where(F.col("cell").isin(cells)) for p in self.parts]
        both = out[0]
        for more in out[1:]:
            both = both.unionByName(more)
        return both

    def cells(self) -> tuple[dict[int, int], np.ndarray]:
        """The rows of each cell, and the smallest cosine to its centroid."""
        count: dict[int, int] = {}
        least = np.ones(len(self.centroids))
        for p in self.parts:
            for cell, n, near in p["cells"]:
                count[cell] = count.get(cell, 0) + n
                if cell >= 0:
                    least[cell] = min(least[cell], near)
        return count, least


def append(rows: DataFrame, path: str, key: str, vector: str = "embedding", cells: int | None = None) -> Vectors:
    """The index at ``path`` with ``rows`` added as a part; the first one fits the centroids."""
    spark = rows.sparkSession
    state = pointers.latest(spark, path, NAME) or {"number": 0, "parts": [], "centroids": []}
    centroids = np.array(state["centroids"]) if len(state["centroids"]) else fitted(rows, key, vector, cells)
    made = written(_assigned(rows, key, vector, centroids), "assigned")
    stats = made.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"))  # a row for each cell
    found = [(r.cell, r.n, r.near) for r in stats.collect()]
    if found:
        # a cell with very many rows is written in several files, whatever share of the rows it has
        files = spark.createDataFrame([(c, 1 + n // ROWS_PER_FILE) for c, n, _ in found], "cell int, files long")
        dealt = made.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.xxhash64("key", "vector"), F.col("files")))
        folder = f"part-{uuid.uuid4().hex}"
        dealt.repartition("cell", "file").select("key", "vector", "cell").write.partitionBy("cell").parquet(f"{path}/{folder}")
        state["parts"] = [*state["parts"], {"folder": folder, "cells": found}]
    state["centroids"] = centroids.tolist()
    pointers.publish(spark, path, NAME, state, state["number"])
    return Vectors(spark, path, state["parts"], centroids)


def open_vectors(spark: SparkSession, path: str) -> Vectors:
    state = pointers.latest(spark, path, NAME)
    if state is None:
        raise FileNotFoundError(f"no vector index at {path}")
    return Vectors(spark, path, state["parts"], np.array(state["centroids"]))


def _best(rows: DataFrame, vectors: list[np.ndarray], wanted: dict[int, list[int]], k: int) -> DataFrame:
    """q (place of a query), key, cosine: each task's ``k`` best rows for each query, of the cells that the query wants."""
    shared = rows.sparkSession.sparkContext.broadcast((vectors, wanted))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wants = shared.value
        best: dict[int, list] = {}
        kth = np.full(len(asked), -1.0)
        schema = None
        for batch in pieces(batches):
            schema = batch.schema.field(0).type
            keys, own, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                queries = wants[cell]
                scores = np.zeros((len(queries), len(at)))
                for length in {len(asked[q]) for q in queries}:
                    mine = [i for i, q in enumerate(queries) if len(asked[q]) == length]
                    same = [i for i, r in enumerate(at) if own[r] is not None and len(own[r]) == length and None not in own[r]]
                    if same and length:
                        found = np.array([asked[queries[i]] for i in mine]) @ _units([own[at[i]] for i in same], length).T
                        scores[np.ix_(mine, same)] = np.round(np.maximum(0, np.nan_to_num(found)), 9)
                few = min(k, len(at))
                for i in np.flatnonzero(scores.max(axis=1, initial=-1.0) >= kth[queries]).tolist():
                    q = queries[i]
                    good = np.flatnonzero(scores[i] >= max(kth[q], np.partition(scores[i], -few)[-few]))
                    best[q] = sorted(best.get(q, []) + [(-scores[i][g], keys[at[g]]) for g in good], key=lambda x: (x[0], x[1] is None, x[1]))[:k]
                    if len(best[q]) == k:
                        kth[q] = -best[q][-1][0]
        out = [(q, y, -x) for q, found in best.items() for x, y in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], schema), pa.array([r[2] for r in out], pa.float64())], names=["q", "key", "cosine"])

    return rows.select("key", "vector", "cell").mapInArrow(run, f"q int, key {kind}, cosine double")


def _bounds(vectors: list[np.ndarray], centroids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each query to each centroid, and what a row of that cell can reach."""
    asked = np.zeros((len(vectors), centroids.shape[1] if len(centroids) else 0))
    for i, v in enumerate(vectors):
        if len(v) == asked.shape[1]:
            asked[i] = v
    near = np.clip(asked @ centroids.T, -1, 1) if len(centroids) else np.zeros((len(vectors), 0))
    bound = np.cos(np.maximum(0, np.arccos(near) - np.arccos(np.clip(least, -1, 1))))
    bound[~asked.any(axis=1)] = 0
    return near, np.maximum(0, bound) + SLACK


def nearest(index: Vectors, queries: DataFrame, k: int, key: str, vector: str = "embedding") -> DataFrame:
    """q, key, cosine, rank: the ``k`` nearest rows of each query by cosine (to nine digits, then by key), as ``ranking.nearest`` gives them.

    Queries go through in blocks of ``VECTORS``; of each block the plans and the k-th cosines lie on the driver, not the rows.
    """
    spark = index.spark
    count, least = index.cells()
    key_type = queries.schema[key].dataType.simpleString()
    kind = index.rows([]).schema["key"].dataType.simpleString() if index.parts else key_type
    found: list[DataFrame] = []
    asked = queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator()
    while index.parts and (block := list(itertools.islice(asked, VECTORS))):
        names = [r[0] for r in block]
        vectors = [_units([r[1]], len(r[1]))[0] if len(r[1]) else np.zeros(0) for r in block]
        near, bounds = _bounds(vectors, index.centroids, least)
        first = [_first(near[i], count, k) for i in range(len(block))]
        one = written(_best(index.rows(sorted(set().union(*first))), vectors, _by_cell(first), k), "near")
        rank = Window.partitionBy("q").orderBy(F.desc("cosine"))
        kth = {r.q: r.cosine for r in one.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select("q", "cosine").collect()}
        more = [{c for c in count if c >= 0 and c not in first[i] and bounds[i, c] >= kth.get(i, 0.0)} for i in range(len(block))]
        both = one
        if any(more):
            both = one.unionByName(written(_best(index.rows(sorted(set().union(*more))), vectors, _by_cell(more), k), "near"))
        named = spark.createDataFrame(list(enumerate(names)), f"place int, name {key_type}")  # VECTORS rows at most
        found.append(both.join(F.broadcast(named), F.col("q") == F.col("place")).select("place", F.col("name").alias("q"), "key", "cosine"))
    if not found:
        return spark.createDataFrame([], f"q {key_type}, {key} {kind}, cosine double, rank int")
    out = found[0].withColumn("block", F.lit(0))
    for i, f in enumerate(found[1:], 1):
        out = out.unionByName(f.withColumn("block", F.lit(i)))
    order = Window.partitionBy("block", "place").orderBy(F.desc("cosine"), F.asc_nulls_last("key"))
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("q", F.col("key").alias(key), "cosine", "rank")


def _first(near: np.ndarray, count: dict[int, int], k: int) -> set[int]:
    """The cells nearest to a query that have ``k`` rows together, and the one that every query reads."""
    out, rows = {c for c in count if c < 0}, 0
    for c in np.argsort(-near, kind="stable").tolist():
        if rows >= k:
            break
        if c in count:
            out.add(c)
            rows += count[c]
    return out


def _by_cell(plan: list[set[int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for q, cells in enumerate(plan):
        for c in cells:
            out.setdefault(c, []).append(q)
    return out
