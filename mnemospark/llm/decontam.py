"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window), a window into word
shingles.  Shingles are ordered by how often they occur in all documents.  A window that is contained wholly in a
document needs all its shingles there, so its necessary prefix is one shingle, its rarest.  The documents'
shingles are looked up among those prefixes; a match at a place fixes where the window would start, which must lie in
the document with room for the window's length (positional and length bounds); then all words of the window
are compared.

The benchmark is the small side, but its size is checked: its distinct rows are split by a hash into blocks of about
``block_bytes`` of text, which are read and broadcast one after the other; what a block hits is written, and the
words hit are joined over the blocks.  Only rows that several blocks have hit are shuffled.

Defined cases: null and empty texts have no words; null item_ids count as the item "null"; items with the same id
are one item; repeated documents are judged one by one; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import persist, rows_without, text_key, tidied

WINDOW = 10
SHINGLE = 5
BLOCK_BYTES = 32 << 20

#: Letters and digits stay, A-Z in lower case; bytes from 0x80 on stay; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word numbers."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ ids[k:k + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Index:
    """The windows of a block of items, and the shingles that they consist of."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.windows = sorted(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.table = np.zeros((len(self.windows), window), dtype=np.int64)
        for i, w in enumerate(self.windows):
            self.table[i, :len(w)] = w
        #: For each width: the distinct shingles of the windows that are cut so.
        self.width = np.minimum(self.lengths, shingle)
        self.shingles = {int(k): np.unique(np.concatenate([_rolled(self.table[i, :self.lengths[i]], k) for i in np.flatnonzero(self.width == k)])) for k in np.unique(self.width)}
        self.prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle by ``counts`` (of the documents, beside ``shingles``)."""
        for k, known in self.shingles.items():
            hashes, windows, places = [], [], []
            for i in np.flatnonzero(self.width == k):
                own = _rolled(self.table[i, :self.lengths[i]], k)
                at = int(np.argmin(counts[k][np.searchsorted(known, own)]))
                hashes.append(own[at])
                windows.append(i)
                places.append(at)
            by = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
            self.prefixes[k] = (np.array(hashes, dtype=np.uint64)[by], np.array(windows)[by], np.array(places)[by])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts (0: in no item), a 0 after each; where each text starts."""
        parts, starts = [], [0]
        get = self.vocab.get
        for t in texts:
            w = words_of(t)
            parts.append(np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w)))
            parts.append(np.zeros(1, dtype=np.int64))
            starts.append(starts[-1] + len(w) + 1)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts)

    def shingled(self, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``k`` words of items stand in a row, and their hashes."""
        known = ids > 0
        ok = known[:len(ids) - k + 1].copy()
        for j in range(1, k):
            ok &= known[j:len(ids) - k + 1 + j]
        at = np.flatnonzero(ok)
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            out = (out ^ ids[at + j].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
        return at, out

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, the spans of words hit (sorted, apart) and the items found."""
        ids, starts = self.numbers(texts)
        marks = np.zeros(len(ids) + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        for k, (hashes, windows, places) in self.prefixes.items():
            if len(ids) < k:
                continue
            at, h = self.shingled(ids, k)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = hi - lo
            hit = np.flatnonzero(n)
            at, lo, n = at[hit], lo[hit], n[hit]
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w, begin = windows[which], np.repeat(at, n) - places[which]
            doc = np.searchsorted(starts, np.repeat(at, n), "right") - 1
            keep = (begin >= starts[doc]) & (begin + self.lengths[w] < starts[doc + 1])
            w, begin, doc = w[keep], begin[keep], doc[keep]
            same = np.ones(len(w), dtype=bool)
            for j in range(self.table.shape[1]):
                live = self.lengths[w] > j
                same &= ~live | (ids[np.minimum(begin + j, len(ids) - 1)] == self.table[w, j])
            w, begin, doc = w[same], begin[same], doc[same]
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + self.lengths[w], -1)
            for d, x in set(zip(doc.tolist(), w.tolist(), strict=True)):
                items.setdefault(d, set()).update(self.items[x])
        covered = np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8), [0]]))
        first, last = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in zip((np.searchsorted(starts, first, "right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
            spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
        return [(int(starts[d + 1] - starts[d] - 1), spans.get(d, []), items.get(d, set())) for d in range(len(texts))]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of blocks, and the distinct items block by block, each read when its turn comes."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= block_bytes else 2 * (total // block_bytes + 1)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return n, ([tuple(r) for r in items.where(block == i).toLocalIterator()] for i in range(n))


def _counted(docs: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """How often each shingle of the index occurs in all documents: rows are bounded by the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = {k: np.zeros(len(s), dtype=np.int64) for k, s in own.shingles.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, _ = own.numbers(batch.column(0).slice(lo, 256).to_pylist())
                for k, known in own.shingles.items():
                    if len(ids) >= k:
                        _, h = own.shingled(ids, k)
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        sums[k] += np.bincount(at[known[at] == h], minlength=len(known))
        for k, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(s[some])], names=["k", "i", "n"])

    out = {k: np.zeros(len(s), dtype=np.int64) for k, s in index.shingles.items()}
    for r in docs.select("text").mapInArrow(tidied(run), "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k][r.i] = r.n
    shared.unpersist()
    return out


_FOUND = "doc_id long, text_key long, n_words long, spans array<int>, items array<string>"


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: doc_id, text_key, n_words, spans (word places begin, end, begin, end, ...) and items (ids found)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), "text")
    n, blocks = _blocks(benchmark, block_bytes)
    parts = []
    for block in blocks:
        index = Index(block, window, shingle)
        index.order(_counted(docs, index))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    found = shared.value.find(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), part.column("text_key"), pa.array([f[0] for f in found], pa.int64()),
                        pa.array([_joined(f[1], []) for f in found], pa.list_(pa.int32())),
                        pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "spans", "items"])

        found = rows.mapInArrow(tidied(run), _FOUND)
        if n == 1:
            return found
        # all rows of the first block, for their numbers of words; of the others what they hit, once for rows that repeat
        parts.append(persist(found if not parts else found.where(F.size("items") > 0).dropDuplicates(["doc_id", "text_key"]), "leak-block"))
        shared.unpersist()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for lists in batch.column("spans").to_pylist():
                own: list[int] = []
                for x in lists:
                    own = _joined([*zip(x[::2], x[1::2], strict=True)], own)
                spans.append(own)
            items = [sorted({i for x in lists for i in x}) for lists in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    more = parts[1]
    for part in parts[2:]:
        more = more.unionByName(part)
    more = more.groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("more_spans"), F.collect_list("items").alias("more_items"))
    more = persist(more.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "more_spans", "more_items"), "leak-more")
    both = parts[0].join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    none = lambda kind: F.array().cast(f"array<array<{kind}>>")
    both = both.select(
        "doc_id", "text_key", "n_words", F.concat(F.array("spans"), F.coalesce("more_spans", none("int"))).alias("spans"),
        F.concat(F.array("items"), F.coalesce("more_items", none("string"))).alias("items"))
    return both.mapInArrow(tidied(merged), _FOUND)


def _joined(new: list[tuple[int, int]], old: list[int]) -> list[int]:
    """Spans of both, sorted, apart."""
    out: list[int] = []
    for a, b in sorted([*new, *zip(old[::2], old[1::2], strict=True)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = find_items(docs, benchmark, window)
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the rows in which a window of an item occurs."""
    found = persist(find_items(docs, benchmark, window).where(F.size("spans") > 0).select("doc_id", "text_key").distinct(), "leaks")
    return rows_without(docs, found)


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
), lens AS (
  SELECT DISTINCT l FROM win
), dwin AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k
  FROM dw, lens, unnest(range(1, len(w) - l + 2)) AS t(i) WHERE len(w) >= l
), found AS (
  SELECT doc_id, i, l, item_id FROM dwin JOIN win USING (l, k)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
