"""Near-duplicate detection by a chosen-path set similarity join.

Each document is the set of its word shingles.  Documents with the same set form a class and go on as one.
A class gets ``t`` minwise tokens (their low bytes travel, which are enough to branch and to compare by).  ``trees``
independent trees start at the root with all classes; a node sends each class down one branch for a minwise token that
the node's own hash selects, and a share of the nodes, drawn by their hashes, down a second one too, so that a node has 1 / similarity
branches for a class on average (1.25 at 0.8); so classes that are alike tend to stay together and others part:

* a node of up to ``small`` classes is compared exhaustively, on minwise tokens;
* a larger one compares all its classes with one member picked by a hash, and is branched again, ``depth`` times at most: within one
  task if it has up to ``inside`` rows, and else by Spark, row by row, until its branches have no more;
* links of the first level are confirmed at once, and what they join counts as one from then on: nodes whose classes are
  all joined end there, and no pair within a component is compared again;
* nodes that are large to the end hold documents on one template.  Those that share members form one group, whose
  classes, where links haven't joined them already, are compared whole: in pairs of blocks, on their full
  sets, so that no sample decides; of each pair of blocks only links that join something come out.

Candidates of the trees must agree on a share of minwise tokens that is five standard deviations below the threshold; every
link is then confirmed on the full sets, read again for the classes that have candidates.  A pair of
similarity 0.8 stays together over k levels of a tree with a probability of at least 0.8^k, so 16 trees miss it with
a probability of at most (1 - 0.8^k)^16: 7e-12 at one level, 8e-8 at two, 1e-5 at three, 2e-4 at four, 2e-3 at five.  Within a group that
is compared whole nothing is missed; its cost grows with the square of the classes that no link has joined.

Components come from min-label propagation with pointer jumping over tables in the shared folder.

Defined cases: a text of fewer words than a shingle is one shingle; without words, or null, the set is empty and
linked with nothing; repeated rows are a class; the representative of a group is its smallest doc_id,
null ids after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import attach_groups, bitmap_of, in_bitmap, persist, rows_matching, rows_without, text_key, tidied

TOKENS = 64
TREES = 16
SMALL = 24
DEPTH = 5
#: A node of up to so many rows (about 200 KB) goes down its further levels within one task.
INSIDE = 2_048
#: A block of a group that is compared whole has about so many classes and shingles at most.
BLOCK = 1_536
BLOCK_SHINGLES = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """A 64-bit hash of each word, kept for up to 150,000 words and no longer than a task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + n]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def _multipliers(t: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return rng.integers(1, 1 << 63, t, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, t, dtype=np.uint64)


def _minwise(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(shingles), 1024):
        x = shingles[lo:lo + 1024, None] * a[None, :] + b[None, :]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0), out=out)
    return (out >> np.uint64(16)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(shingles.tobytes())


def _described(docs: DataFrame, width: int, t: int, trees: int) -> DataFrame:
    """Each row's set size, a digest of its set, the root tokens of all trees and the low bytes of all minwise tokens."""
    a, b = _multipliers(t)
    roots = np.arange(trees) % t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle_set(x, width) for x in part.column(2).to_pylist()]
                tokens = [_minwise(s, a, b) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else x[roots].astype("<u4").tobytes() for x in tokens], pa.binary()),
                    pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in tokens], pa.binary())],
                    names=["doc_id", "text_key", "n", "cls", "roots", "sig"])
        _hashes.clear()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, text_key long, n long, cls binary, roots binary, sig binary")


def _similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float, percent: int) -> np.ndarray:
    """Which pairs can be links: sizes allow it, and enough minwise tokens agree."""
    sizes = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    return sizes & ((x == y).sum(axis=1) >= least * x.shape[1])


def _pairs_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sigs(column: pa.Array, t: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, t)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, sorted by node, in tables that hold whole nodes; no more than one node beyond a batch is kept."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        node = table.column("node").to_numpy()
        cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if (node != node[-1]).any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


class _Nodes:
    """Rows of nodes as arrays (``cid``, ``comp``, ``n``, ``sig``), and what can be links among them."""

    def __init__(self, table: pa.Table, t: int, least: float, percent: int):
        self.node, self.cid, self.comp, self.n = (table.column(x).to_numpy() for x in ("node", "cid", "comp", "n"))
        self.sig, self.least, self.percent = _sigs(table.column("sig"), t), least, percent

    def pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows (i, j) that are candidates, by their classes."""
        apart = self.comp[i] != self.comp[j]
        i, j = i[apart], j[apart]
        ok = _similar(self.sig[i], self.sig[j], self.n[i], self.n[j], self.least, self.percent)
        a, b = self.cid[i[ok]], self.cid[j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    def within(self, node: np.ndarray, at: np.ndarray, small: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Candidates among rows ``at`` that stand in one node of up to ``small`` (``node``: ascending)."""
        out = []
        for d in range(1, min(small, len(node))):
            near = np.flatnonzero(node[d:] == node[:-d])
            if not len(near):
                break
            out.append(self.pairs(at[near], at[near + d]))
        return out


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of all ``found``."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in found]]) for i in (0, 1))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _compare_small(rows: DataFrame, small: int, t: int, least: float, percent: int) -> DataFrame:
    """Candidate pairs of different components within nodes of up to ``small`` rows (node, cid, comp, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            rows = _Nodes(table, t, least, percent)
            yield _pairs_batch(*_joined(rows.within(rows.node, np.arange(len(rows.node)), small)))

    return rows.repartition("node").sortWithinPartitions("node").select("node", "cid", "comp", "n", "sig").mapInArrow(tidied(run), "a long, b long")


def _mixed_bits(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x.astype(np.int64).view(np.uint64) + np.uint64(salt + 1) * _MIX
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _descend(rows: DataFrame, count: int, level: int, depth: int, inside: int, small: int, t: int, least: float, percent: int) -> DataFrame:
    """All further levels of nodes of up to ``inside`` rows (node, cid, comp, n, sig), each node in one task.

    The branching is that of larger nodes.  Gives candidates (a, b), and as ``stuck`` the rows of nodes that are
    large at the last level, as (node, cid).  A task gets several nodes' worth of rows, so that tasks are even.
    """
    second = 100 / percent - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            rows = _Nodes(table, t, least, percent)
            node, at, found = rows.node, np.arange(len(rows.node)), []
            for d in range(level, depth + 1):
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
                own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
                # the member that each is compared with: the one with the smallest hash
                by = np.lexsort((_mixed_bits(rows.cid[at], 1_000 + d), own))
                found.append(rows.pairs(at, at[by[starts]][own]))
                if d == depth or not len(node):
                    break
                ids = node[starts]
                one = (_mixed_bits(ids, 3 * d) % np.uint64(t)).astype(np.int64)
                two = (one + 1 + (_mixed_bits(ids, 3 * d + 1) % np.uint64(max(1, t - 1))).astype(np.int64)) % t
                more = np.flatnonzero((_mixed_bits(ids, 3 * d + 2) >> np.uint64(11)).astype(np.float64)[own] < second * 2.0**53)
                own, at, token = np.r_[own, own[more]], np.r_[at, at[more]], np.r_[one[own], two[own[more]]]
                # a child is named by its node, the number of the token and the token itself
                node = _mixed_bits(ids[own] ^ _mixed_bits(token * 256 + rows.sig[at, token], 7).view(np.int64), 3 * depth + d).view(np.int64)
                order = np.argsort(node, kind="stable")
                node, at = node[order], at[order]
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                size = np.diff(np.r_[starts, len(node)])
                comp = rows.comp[at]
                size[np.minimum.reduceat(comp, starts) == np.maximum.reduceat(comp, starts)] = 0  # of one component
                size = np.repeat(size, np.diff(np.r_[starts, len(node)]))
                few = (size > 0) & (size <= small)
                found += rows.within(node[few], at[few], small)
                node, at = node[size > small], at[size > small]
            a, b = _joined(found)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[a, node], pa.int64()), pa.array(np.r_[b, rows.cid[at]], pa.int64()),
                pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(node), bool)], pa.bool_())], names=["a", "b", "stuck"])

    tasks = max(1, -(-count // (4 * inside)))
    dealt = rows.repartition(tasks, "node").sortWithinPartitions("node").select("node", "cid", "comp", "n", "sig")
    return dealt.mapInArrow(tidied(run), "a long, b long, stuck boolean")


def _compare_hub(large: DataFrame, count: int, way: int, t: int, least: float, percent: int) -> DataFrame:
    """Candidate pairs of each row of a large node with the member that a hash picks; nodes with much the same rows tend to pick the same."""
    hubs = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("cid", F.lit(way)).alias("h"), "cid", "comp", "n", "sig")).alias("x"), F.first("node_n").alias("hub_of"))
    hubs = hubs.select("node", "hub_of", F.col("x.cid").alias("hub"), F.col("x.comp").alias("hub_comp"), F.col("x.n").alias("hub_n"), F.col("x.sig").alias("hub_sig"))
    both = attach_groups(large.select("node", "cid", "comp", "n", "sig"), hubs, "node", "hub_of", count, named=True).where("comp <> hub_comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, hub = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            ok = _similar(_sigs(batch.column(2), t), _sigs(batch.column(5), t), batch.column(1).to_numpy(), batch.column(4).to_numpy(), least, percent)
            yield _pairs_batch(np.minimum(cid, hub)[ok], np.maximum(cid, hub)[ok])

    return both.select("cid", "n", "sig", "hub", "hub_n", "hub_sig").dropDuplicates(["cid", "hub"]).mapInArrow(tidied(run), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, width: int, bits: int) -> DataFrame:
    """The full sets (cid, shingles) of the ``wanted`` classes (cid), from the rows that represent them."""
    named = persist(classes.join(wanted, "cid", "left_semi").select("cid", "cls", "doc_id", "text_key"), "near-wanted")
    bitmap = persist(bitmap_of(named, F.xxhash64("doc_id", "text_key"), bits), "near-reps")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), "text")
    rows = in_bitmap(rows, F.xxhash64("doc_id", "text_key"), bitmap, "hit", bits).where("hit").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                sets = [s for x in batch.column(0).slice(lo, 512).to_pylist() if len(s := shingle_set(x, width))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "shingles"])
        _hashes.clear()

    found = rows.mapInArrow(tidied(run), "cls binary, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    return persist(found.join(named.select("cid", "cls"), "cls").select("cid", "shingles"), "near-sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """The pairs of classes (a, b) whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = _sets(docs, wanted, classes, width, bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = []
                for i, (x, y) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        keep.append(i)
                yield _pairs_batch(part.column(0).to_numpy()[keep], part.column(1).to_numpy()[keep])

    first = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(tidied(compare), "a long, b long")


def _shared(sets: list[np.ndarray], left: int, chunk: int = 2048) -> np.ndarray:
    """How many shingles each of the first ``left`` sets shares with each other one (with each of them all, if there is no other)."""
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, who = flat[order], who[order]
    col = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
    often = np.bincount(col) > 1
    who, col = who[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    right = left if left < len(sets) else 0
    out = np.zeros((left, len(sets) - right), dtype=np.int32)
    for lo in range(0, int(often.sum()), chunk):
        i, j = np.searchsorted(col, [lo, lo + chunk])
        has = np.zeros((len(sets), chunk), dtype=np.float32)
        has[who[i:j], col[i:j] - lo] = 1
        out += (has[:left] @ has[right:].T).astype(np.int32)
    return out


def _compare_whole(docs: DataFrame, rest: DataFrame, labels: DataFrame, classes: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """Links (a, b) that join components ``labels`` (v, comp) within the groups that the large nodes ``rest`` (node, cid) form.

    A group is dealt into blocks of about one set size, those of a component with many members apart; each pair of blocks that
    isn't of one such component, and whose sizes allow links, is a unit of work.
    """
    count = rest.count()
    hubs = rest.groupBy("node").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("of"))
    spokes = attach_groups(rest, hubs, "node", "of", count).where("hub <> cid").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    known = components(spokes, "near-rest").select(F.col("v").alias("cid"), F.col("comp").alias("grp")).join(classes.select("cid", "n"), "cid")
    known = known.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    known = persist(known.withColumn("part", F.xxhash64("grp", "comp")), "near-rest")
    mixed = known.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("of")).where("lo <> hi")
    known = attach_groups(known, mixed.select("grp", "of"), "grp", "of", count).where("of is not null").drop("of")
    big = known.groupBy("part").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= BLOCK)
    known = attach_groups(known, big, "part", "members", count).withColumn("part", F.when(F.col("members").isNotNull(), F.col("part")).otherwise(0)).drop("members")
    # sets that can be linked are in the same size or in the next one
    known = known.withColumn("size", F.floor(F.log("n") / max(1.001 * float(np.log(100 / percent)), 1e-3)))
    known = persist(known.withColumn("deal", F.xxhash64("grp", "part", "size")), "near-rest")
    dealt = known.groupBy("deal").agg(F.count(F.lit(1)).alias("of"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = attach_groups(known, dealt, "deal", "of", count).withColumn("block", F.xxhash64("deal", F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    rows = persist(rows.select("grp", "part", "size", "block", "cid", "comp"), "near-rest")
    blocks = persist(rows.select("grp", "part", "size", "block").distinct(), "near-blocks")
    other = blocks.select("grp", *[F.col(c).alias(f"{c}2") for c in ("part", "size", "block")])
    units = blocks.join(other, "grp").where("block <= block2 and abs(size - size2) <= 1 and (part <> part2 or part = 0)")
    units = units.select(F.xxhash64("block", "block2").alias("unit"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    units = persist(units, "near-units")
    rows = persist(rows.join(units, "block", "left_semi").select("block", "cid", "comp"), "near-rest")
    sets = _sets(docs, rows.select("cid"), classes, width, bits)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        block, cid, comp = (table.column(x).to_numpy() for x in ("block", "cid", "comp"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets])
        left = int((block == block[0]).sum())
        right = left if left < len(sets) else 0
        both = _shared(sets, left)
        ids = np.unique(comp, return_inverse=True)[1]
        ok = (100 * both >= percent * (n[:left, None] + n[None, right:] - both)) & (ids[:left, None] != ids[None, right:])
        into = list(range(len(sets)))

        def top(x: int) -> int:
            while into[x] != x:
                into[x] = x = into[into[x]]
            return x

        a, b = [], []
        for i, j in np.argwhere(ok).tolist():
            x, y = top(int(ids[i])), top(int(ids[right + j]))
            if x != y:
                into[x] = y
                a.append(min(cid[i], cid[right + j]))
                b.append(max(cid[i], cid[right + j]))
        return pa.Table.from_batches([_pairs_batch(a, b)])

    return rows.join(sets, "cid").join(units, "block").select("unit", "block", "cid", "comp", "shingles").groupBy("unit").applyInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "near-labels") -> DataFrame:
    """Connected components of ``links`` (a, b): v and its component's smallest name ``comp``."""
    ways = persist(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))), name)
    labels = persist(ways.groupBy("v").agg(F.min("u").alias("l")).select("v", F.least("v", "l").alias("comp")), name)
    while True:
        near = ways.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        step = labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        step = persist(step, name)
        jump = step.select(F.col("v").alias("comp"), F.col("comp").alias("far"))
        after = persist(step.join(jump, "comp", "left").select("v", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), name)
        changed = after.where("comp <> was").limit(1).count()
        labels = after.select("v", "comp")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL, depth: int = DEPTH, t: int = TOKENS, bits: int = 23,
    inside: int = INSIDE,
) -> DataFrame:
    """For each row: doc_id, text_key, n_shingles, component_id (smallest doc_id of its group), kept."""
    rows = persist(_described(docs, width, t, trees), "near-docs")
    total = rows.count()
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"),
        F.first("roots").alias("roots"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    classes = persist(classes.select(
        F.monotonically_increasing_id().alias("cid"), "cls", "n", "roots", "sig", "docs", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_key").alias("text_key")), "near-classes")

    p = percent / 100
    least = p - 5 * (p * (1 - p) / t) ** 0.5

    def confirmed(found: list[DataFrame]) -> DataFrame:
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.union(more)
        return persist(_confirmed(docs, persist(pairs.distinct(), "near-pairs"), classes, width, percent, bits), "near-links")

    # the first level: every class stands in a node of each tree
    roots = F.array(*[F.xxhash64(F.lit(r), F.substring("roots", 4 * r + 1, 4)) for r in range(trees)])
    level = persist(classes.select("cid", F.explode(roots).alias("node")), "near-level")
    counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("node_n")).where("node_n > 1")
    live = attach_groups(level, counts, "node", "node_n", level.count(), named=True).where("node_n is not null")
    live = persist(live.join(classes.select("cid", F.col("cid").alias("comp"), "n", "sig"), "cid"), "near-nodes")
    found = [_compare_small(live.where(F.col("node_n") <= small), small, t, least, percent)]
    large = live.where(F.col("node_n") > small)
    n_large = large.count()
    if n_large:
        found.append(_compare_hub(large, n_large, 0, t, least, percent))
    links = confirmed(found)
    labels = components(links)

    # from now on a component's classes aren't compared with each other, and nodes of one component alone end
    found, stuck = [], []
    if n_large:
        large = large.drop("comp").join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        live = _mixed(large.drop("node_n"), n_large)
        for d in range(1, depth + 1):
            large = live.where(F.col("node_n") > small)
            if d == depth:
                stuck.append(large.select("node", "cid"))
                break
            fit = large.where(F.col("node_n") <= inside)
            if n_fit := fit.count():
                below = persist(_descend(fit, n_fit, d, depth, inside, small, t, least, percent), "near-below")
                found.append(below.where("not stuck").select("a", "b"))
                stuck.append(below.where("stuck").select(F.col("a").alias("node"), F.col("b").alias("cid")))
            large = large.where(F.col("node_n") > inside)
            if not large.limit(1).count():
                break
            # which token a node selects depends on the node alone; 1 / p - 1 of the nodes send their rows down a second branch
            one = F.pmod(F.xxhash64("node", F.lit(d), F.lit("one")), F.lit(t)).cast("int")
            two = F.pmod(F.xxhash64("node", F.lit(d), F.lit("two")), F.lit(t)).cast("int")
            more = F.pmod(F.xxhash64("node", F.lit(d), F.lit("more")), F.lit(10_000)) < round(10_000 * (1 / p - 1))
            token = lambda j: F.substring(F.col("sig"), j + 1, F.lit(1))
            branch = F.array_compact(F.array(F.xxhash64("node", one, token(one)), F.when(more, F.xxhash64("node", two, token(two)))))
            level = persist(large.select("cid", "comp", "n", "sig", F.explode(branch).alias("node")), "near-level")
            live = _mixed(level, level.count())
            found.append(persist(_compare_small(live.where(F.col("node_n") <= small), small, t, least, percent).distinct(), "near-pairs"))
            large = live.where(F.col("node_n") > inside)
            if n_large := large.count():
                found.append(persist(_compare_hub(large, n_large, d, t, least, percent).distinct(), "near-pairs"))
    if found:
        links = persist(links.union(confirmed(found)), "near-links")
        labels = components(links)
    if stuck:
        rest = stuck[0]
        for more in stuck[1:]:
            rest = rest.union(more)
        if rest.limit(1).count():
            joins = persist(_compare_whole(docs, rest, labels, classes, width, percent, bits), "near-links")
            if joins.limit(1).count():
                labels = components(persist(links.union(joins), "near-links"))

    known = classes.select("cid", "cls", "docs", "doc_id").join(labels.withColumnRenamed("v", "cid"), "cid")
    first_id = persist(known.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("of")), "near-first")
    linked = persist(attach_groups(known.select("cid", "cls", "docs", "comp"), first_id, "comp", "of", total).select("cid", "cls", "docs", "component_id"), "near-linked")
    alone = classes.select("cid", "cls", "docs", F.col("doc_id").alias("component_id")).where("docs > 1").join(linked, "cid", "left_anti")
    groups = persist(linked.select("cls", "docs", "component_id").unionByName(alone.select("cls", "docs", "component_id")), "near-groups")
    out = attach_groups(rows.select("doc_id", "text_key", "n", "cls"), groups, "cls", "docs", total)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _mixed(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` (node, cid, comp, n, sig) of nodes that hold several components, with the node's number of rows."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("node_n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    live = attach_groups(rows.select("node", "cid", "comp", "n", "sig"), counts.select("node", "node_n"), "node", "node_n", count, named=True)
    return persist(live.where("node_n is not null"), "near-nodes")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates (of rows that repeat wholly, one)."""
    found = persist(near_duplicates(docs, width, percent).where("n_shingles > 0"), "near-found")
    gone = persist(found.where("not kept").select("doc_id", "text_key").distinct(), "near-gone")
    left = rows_without(docs, gone)
    again = found.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    again = persist(again, "near-twice")
    if not again.limit(1).count():
        return left
    return rows_without(left, again).unionByName(rows_matching(left, again).dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS k
  FROM w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r
), c AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
