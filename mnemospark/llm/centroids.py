"""Clustering around integer centroids by partial-distance search.

Vectors become integers once, in a table of the shared folder.  Each round a task assigns its vectors and adds them up, and Spark adds
the tasks' sums by cluster and component; the driver holds the centroids alone (``k`` times ``DIMENSIONS`` numbers).

The search adds up integer squared differences over the components of highest variance first.  After the first block every vector
takes the centroid that is nearest so far and finishes it: its distance is the bound.  After each further block the centroids that
are strictly above the bound are abandoned; those that are left at the end have their whole distances, and the smallest wins, of
equal ones the one with the smallest number.  All sums are whole numbers, so neither the order of components nor of tasks matters.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; repeated rows are
vectors of their own; with fewer vectors than ``k`` there are as many centroids as vectors; none give an empty result; a null vec_id counts
as the empty text in the hash.  Components whose squared differences could leave 64 bits (over 2 ** 28 after scaling) raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import persist, tidied

DIMENSIONS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, "2"
#: Components of a block of the search, and vectors searched at once.
BLOCK, AT_ONCE = 16, 4096
MOST = 1 << 28


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, v: the kept vectors as floor(256 * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == DIMENSIONS)).select(key, x.alias("x")).where(F.forall("x", finite))
    return kept.select(key, F.transform("x", lambda c: F.floor(c * float(SCALE)).cast("long")).alias("v"))


def table_of(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as a matrix."""
    out = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
    if out.size and np.abs(out).max() > MOST:
        raise ValueError(f"a component is over {MOST} after scaling: distances would leave 64 bits")
    return out


def search(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and its squared distance, over the components in ``order``."""
    v, c = vectors[:, order], centroids[:, order]
    part = np.zeros((len(v), len(c)), dtype=np.int64)
    for j in range(len(c)):
        part[:, j] = ((v[:, :BLOCK] - c[j, :BLOCK]) ** 2).sum(axis=1)
    near = part.argmin(axis=1)
    bound = part[np.arange(len(v)), near] + ((v[:, BLOCK:] - c[near, BLOCK:]) ** 2).sum(axis=1)
    row, col = np.nonzero(part <= bound[:, None])
    so_far = part[row, col]
    for lo in range(BLOCK, DIMENSIONS, BLOCK):
        so_far = so_far + ((v[row, lo:lo + BLOCK] - c[col, lo:lo + BLOCK]) ** 2).sum(axis=1)
        alive = so_far <= bound[row]
        row, col, so_far = row[alive], col[alive], so_far[alive]
    best = np.lexsort((col, so_far, row))
    first = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))] if len(best) else best
    return col[first], so_far[first]


def _spread(numbers: DataFrame) -> np.ndarray:
    """The components from the highest variance to the lowest (n times the sum of squares less the square of the sum, which orders them alike)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for batch in batches:
            t = table_of(batch.column(0)).astype(np.float64)
            n, total, square = n + len(t), total + t.sum(axis=0), square + (t ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(DIMENSIONS, dtype=np.int32), "n": np.full(DIMENSIONS, n, dtype=np.int64), "s": total, "q": square})

    found = numbers.select("v").mapInArrow(tidied(run), "d int, n long, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    return np.array([r.d for r in sorted(found, key=lambda r: (-(r.q / r.n - (r.s / r.n) ** 2), r.d))])


def _moved(numbers: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; empty ones stay."""
    schema = "cluster int, d int, s long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            table = table_of(batch.column(0))
            for lo in range(0, len(table), AT_ONCE):
                part = table[lo:lo + AT_ONCE]
                at, _ = search(part, centroids, order)
                np.add.at(sums, at, part)
                counts += np.bincount(at, minlength=len(centroids))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(own.astype(np.int32), DIMENSIONS), "d": np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(own)),
            "s": sums[own].ravel(), "n": np.repeat(counts[own], DIMENSIONS)})

    out = centroids.copy()
    added = numbers.select("v").mapInArrow(tidied(run), schema).groupBy("cluster", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    for r in added.collect():  # k * 64 rows, whatever the input
        out[r.cluster, r.d] = r.s // r.n
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of the kept vectors after ``rounds`` rounds, and the centroids."""
    spark = vectors.sparkSession
    numbers = persist(whole_numbers(vectors, key, vector), "whole-numbers")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    first = numbers.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()  # k rows
    kind = vectors.schema[key].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long"), np.zeros((0, DIMENSIONS), dtype=np.int64)
    centroids, order = np.array([r.v for r in first], dtype=np.int64), _spread(numbers)
    for _ in range(rounds):
        centroids = _moved(numbers, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = table_of(batch.column(1))
            parts = [search(table[lo:lo + AT_ONCE], centroids, order) for lo in range(0, len(table), AT_ONCE)]
            at, far = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(far, pa.int64())], names=[key, "cluster", "distance"])

    return persist(numbers.mapInArrow(tidied(run), f"{key} {kind}, cluster int, distance long"), "clusters"), centroids


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    rows, centroids = cluster(vectors, k, rounds, seed)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    known = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids) if j in sums]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # table: at most k rows


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same rows in SQL."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS j, x FROM v QUALIFY j < {k})"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT v.id, v.vec_id, v.x, c.j, {far} AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY {far}, c.j) = 1)")
        if r < rounds:
            ctes.append(f"""m{r} AS (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, (s - ((s % n) + n) % n) // n AS m FROM (
SELECT j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY j, i)) GROUP BY j)""")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))")
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN (SELECT j, x FROM c{rounds}) c USING (j)"""
