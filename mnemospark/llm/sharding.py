"""Resharding by minimum-cost flow.

From the bytes of the old shards and the capacities of the new ones, a minimum-cost flow (successive shortest paths on
the small graph old shard -> new shard, on the driver) says how many bytes each old shard sends to each new one; bytes
that stay under their number cost nothing, so the fewest bytes move.  Each old shard is then cut at byte
offsets: its documents in the order of doc_id, offsets from two-pass prefix sums over range partitions.  Documents
that lie on or near a cut (a bounded number) are dealt at last, largest first, to the shard with most room, which
brings the new sizes within about a small document of each other.  Slots are ranks from prefix sums too.

Defined cases: a null text has no bytes (size 8); null doc_ids come first; repeated rows are placed one by one; null
sources are one source; an empty table gives an empty result; other columns are ignored, but kept by ``rewrite`` (a column
``shard`` is replaced by the new number).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import partitions_for, persist, text_of

OLD_SHARDS = 16
NEW_SHARDS = 24
#: Bytes on either side of a cut whose documents are dealt at last: so many at most, and this share of a shard.
MARGIN_BYTES, MARGIN_SHARE = 32 << 10, 1 / 25


def capacities(total: int, n: int) -> list[int]:
    """Equal shares of ``total``, the first ones larger by one where it doesn't divide."""
    return [total // n + (i < total % n) for i in range(n)]


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Units from each supplier to each receiver at the least total ``cost(i, j)``; capacities sum to the supplies or more.

    Successive shortest paths: each round finds the cheapest path (Bellman-Ford, over residual arcs) from a supplier
    with units left to a receiver with room left and sends all it can.
    """
    m, n = len(supply), len(capacity)
    left, room = [*supply], [*capacity]
    flow: dict[tuple[int, int], int] = {}
    costs = [[cost(i, j) for j in range(n)] for i in range(m)]
    while any(left):
        far = [0 if left[i] else None for i in range(m)] + [None] * n
        before: list[int | None] = [None] * (m + n)
        moved = True
        while moved:
            moved = False
            for i in range(m):
                if far[i] is None:
                    continue
                for j in range(n):
                    d = far[i] + costs[i][j]
                    if far[m + j] is None or d < far[m + j]:
                        far[m + j], before[m + j], moved = d, i, True
            for (i, j), f in flow.items():
                if f and far[m + j] is not None and (far[i] is None or far[m + j] - costs[i][j] < far[i]):
                    far[i], before[i], moved = far[m + j] - costs[i][j], m + j, True
        j = min((j for j in range(n) if room[j] and far[m + j] is not None), key=lambda j: far[m + j], default=None)
        if j is None:
            raise ValueError("the capacities are less than the supplies")
        path = [m + j]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        path.reverse()
        start, send = path[0], min(left[path[0]], room[j])
        for a, b in zip(path, path[1:], strict=False):
            if a >= m:
                send = min(send, flow[b, a - m])
        for a, b in zip(path, path[1:], strict=False):
            if a < m:
                flow[a, b - m] = flow.get((a, b - m), 0) + send
            else:
                flow[b, a - m] -= send
        left[start] -= send
        room[j] -= send
    return {k: f for k, f in flow.items() if f}


def transfers(old_sizes: dict[int, int], capacity: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard) for each block; what stays comes first."""
    olds = sorted(old_sizes)
    flow = min_cost_flow([old_sizes[o] for o in olds], capacity, lambda i, j: 0 if olds[i] == j else 1)
    out = []
    for i, o in enumerate(olds):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != o, j)):
            out.append((o, at, at + flow[i, j], j))
            at += flow[i, j]
    return out


def _prefix(rows: DataFrame, by: str, value, order: list[str], out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the same ``by`` before this one, in the order of (part, order).

    Partition totals (a number for each partition and group in it) are summed on the driver.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("part", by).agg(F.sum(value).alias("v")).orderBy("part").collect()
    at: dict = {}
    base = []
    for r in totals:
        base.append((r["part"], r[by], at.get(r[by], 0)))
        at[r[by]] = at.get(r[by], 0) + r.v
    bases = spark.createDataFrame(base, f"part int, {by} int, _base long")
    w = Window.partitionBy("part", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_run", F.sum(value).over(w) - value).join(F.broadcast(bases), ["part", by]).withColumn(out, F.col("_run") + F.col("_base")).drop("_run", "_base")


def assign(docs: DataFrame, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot for each row; an old shard is a hash of the source."""
    spark = docs.sparkSession
    raw = text_of(docs).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.pmod(F.xxhash64("source"), F.lit(n_old)).cast("int").alias("old_shard"))
    order = ["old_shard", "doc_id", "text_crc32", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = persist(slim, "shard-sizes")
    ranged = slim.repartitionByRange(max(parts, partitions_for(slim)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = persist(ranged, "shard-ranges")
    sizes = {r.old_shard: r.v for r in ranged.groupBy("old_shard").agg(F.sum("size").alias("v")).collect()}  # n_old rows
    total = sum(sizes.values())
    caps = capacities(total, n_new)
    blocks = transfers(sizes, caps)
    margin = min(MARGIN_BYTES, int(caps[0] * MARGIN_SHARE))
    first = {o: min(b[1] for b in blocks if b[0] == o) for o in sizes}
    table = spark.createDataFrame(
        [(o, lo, hi, j, lo + margin if lo > first[o] else lo, hi - margin if hi < sizes[o] else hi) for o, lo, hi, j in blocks],
        "old_shard int, lo long, hi long, new int, sure_from long, sure_to long")

    offset = persist(_prefix(ranged, "old_shard", F.col("size"), order[1:], "start"), "shard-offsets")
    placed = offset.join(F.broadcast(table), "old_shard").where("start >= lo and start < hi")
    sure = (F.col("start") >= F.col("sure_from")) & (F.col("start") + F.col("size") <= F.col("sure_to"))
    placed = persist(placed.withColumn("shard", F.when(sure, F.col("new"))).drop("lo", "hi", "new", "sure_from", "sure_to"), "shard-placed")

    room = [*caps]
    for r in placed.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("v")).collect():
        room[r.shard] -= r.v
    last = []
    near = placed.where("shard is null").select("old_shard", "start", "size").collect()  # at most cuts * (2 * margin / 8 + 1) rows
    for r in sorted(near, key=lambda r: (-r["size"], r.old_shard, r.start)):
        j = max(range(n_new), key=lambda j: (room[j], j == r.old_shard, -j))
        room[j] -= r["size"]
        last.append((r.old_shard, r.start, j))
    dealt = spark.createDataFrame(last, "old_shard int, start long, _late int")
    full = placed.join(F.broadcast(dealt), ["old_shard", "start"], "left").withColumn("shard", F.coalesce("shard", "_late")).drop("_late")
    full = persist(full, "shard-full")
    return _prefix(full, "shard", F.lit(1).cast("long"), ["old_shard", "start"], "slot").select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "start")


def affected(assigned: DataFrame) -> list[int]:
    """The shards whose files change: those that lose or gain a document."""
    moved = assigned.where("old_shard <> shard")
    return sorted(r.s for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect())


def rewrite(docs: DataFrame, assigned: DataFrame, path: str) -> list[int]:
    """Write the affected shards of ``docs`` below ``path`` (folders shard=0, shard=1, ...); the others' files stay as they are.

    A new shard is written beside the old files; only shards that get rows are replaced, each as a whole, when all of
    them are written.  The folders of old shards that lose all their rows are removed at last.
    """
    spark = docs.sparkSession
    touched = affected(assigned)
    own = "__ms"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    i, crc, size, shard, n, k = (f"{own}_{x}" for x in ("id", "crc", "size", "shard", "n", "k"))
    names = assigned.select(
        F.col("doc_id").alias(i), F.col("text_crc32").alias(crc), F.col("size").alias(size), F.col("shard").alias(shard)).withColumn(
        n, F.row_number().over(Window.partitionBy(i, crc, size).orderBy(shard))).where(F.col(shard).isin(touched))
    raw = text_of(docs).cast("binary")
    keyed = docs.withColumn(f"{own}_c", F.crc32(raw)).withColumn(f"{own}_s", (F.octet_length(raw) + 8).cast("long"))
    keyed = keyed.withColumn(k, F.row_number().over(Window.partitionBy("doc_id", f"{own}_c", f"{own}_s").orderBy(F.xxhash64(*docs.columns))))
    out = keyed.join(names, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(f"{own}_c") == F.col(crc)) & (F.col(f"{own}_s") == F.col(size)) & (F.col(k) == F.col(n)))
    rows = persist(out.select(*[c for c in docs.columns if c != "shard"], F.col(shard).alias("shard")), "shard-rewrite")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r["shard"] for r in rows.select("shard").distinct().collect()}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for s in sorted(set(touched) - left):
        gone = folder(f"{path.rstrip('/')}/shard={s}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return touched
