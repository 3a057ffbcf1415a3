"""Removal of repeated byte strings with a sparse suffix array.

A byte goes when a string of ``length`` (200) bytes that covers it also starts anywhere else.  Any such string
holds a content-defined anchor: of its 32-byte grams the one with the smallest hash.  Equal strings
have equal anchors at equal places, so only anchors (about 1 in 85 bytes) take part, not all suffixes:

1. count the anchors' hashes over all documents; hashes that occur once drop out (a bitmap of bounded size
   takes the others to the second scan);
2. the surviving anchors go, with 168 bytes to the left and 200 from the anchor on, to the task of their hash.
   There the suffixes that start at anchors are sorted deep-shallow: multikey quicksort on 8-byte characters
   down to a shallow depth, then blind tries order the groups that still share a prefix;
3. neighbours' common prefixes say which suffixes agree for 200 - s bytes, hashes of the left side
   which agree for s bytes before; where both hold for another anchor, the string that starts s bytes before
   the anchor is repeated.  The first and last such s give the bytes that the anchor removes.

Anchors that occur over ``hot`` times (a millionth of all occurrences at least, which bounds their number) stand in lines or passages that
repeat, so most of their surroundings are the same bytes.  Equal surroundings are counted with partial sums, within a document
already where it is read; one of each goes to the sort, and its answer goes back to its places by ``attach_groups``.

Defined cases: null texts are empty; texts under 200 bytes lose nothing; strings never cross documents; repeated rows
repeat each other's strings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import attach_groups, bitmap_of, in_bitmap, persist, text_key, text_of, tidied

LENGTH = 200
GRAM = 32
#: Bytes after the anchor's gram that the multikey quicksort looks at.
SHALLOW = 32
HOT = 20_000
#: The hot anchors are broadcast: over all occurrences / MOST_HOT is hot at least, so there are fewer than that.
MOST_HOT = 1_000_000
#: Rows that a task sorts at once (more only where one anchor has more).
CHUNK = 8_000

_rng = np.random.Generator(np.random.PCG64(987654321))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    have, cur = 1, values
    while have * 2 <= width:
        cur = pick(cur[:-have], cur[have:])
        have *= 2
    n = len(values) - width + 1
    return pick(cur[:n], cur[width - have:width - have + n])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text's bytes: of each ``length`` bytes, the gram(s) of smallest hash."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, have, i = _BYTE[data], 1, 0
    while have < GRAM:
        h = h[:-have] * _ODD[i] + h[have:]
        have, i = have * 2, i + 1
    h ^= h >> np.uint64(31)
    h *= _ODD[-1]
    h ^= h >> np.uint64(29)
    width = length - GRAM + 1
    least = _slide(h, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    return at, h[at]


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie: an inner node knows only its depth and its branches' bytes; one comparison, with the leaf
    that a blind descent ends at, tells where a new string parts."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, text: bytes, row: int) -> None:
        # inner node: [depth, {byte or -1: child}]; leaf: [text, rows, None]
        if self.root is None:
            self.root = [text, [row], None]
            return
        node = self.root
        while len(node) == 2:
            key = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(key) or next(iter(node[1].values()))
        shared = common_prefix(text, node[0])
        if shared == len(text) == len(node[0]):
            node[1].append(row)
            return
        parent, key, cur = None, None, self.root
        while len(cur) == 2 and cur[0] < shared:
            parent, key = cur, text[cur[0]]
            cur = cur[1][key]
        mine = text[shared] if shared < len(text) else -1
        if len(cur) == 2 and cur[0] == shared:
            cur[1][mine] = [text, [row], None]
            return
        theirs = node[0][shared] if shared < len(node[0]) else -1
        made = [shared, {mine: [text, [row], None], theirs: cur}]
        if parent is None:
            self.root = made
        else:
            parent[1][key] = made

    def rows(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
            else:
                out.extend(node[1])
        return out


def deep_shallow(rows: list[int], texts: list[bytes], start: int = GRAM, shallow: int = SHALLOW) -> list[int]:
    """``rows`` in the order of ``texts``, which agree on their first ``start`` bytes.

    Ternary partitions on 8 bytes at a time down to ``start + shallow``; rows that still tie go to a blind trie.
    """
    out: list[int] = []
    stack = [(rows, start)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1:
            out.append(part[0])
        elif depth >= start + shallow:
            trie = BlindTrie()
            for r in part:
                trie.add(texts[r], r)
            out.extend(trie.rows())
        else:
            end = depth + 8
            pivot = texts[part[len(part) // 2]][depth:end]
            less, same, more = [], [], []
            for r in part:
                c = texts[r][depth:end]
                (same if c == pivot else less if c < pivot else more).append(r)
            if more:
                stack.append((more, depth))
            # texts that end here are equal or differ in length alone: the trie orders them too
            stack.append((same, end if len(pivot) == 8 else start + shallow))
            if less:
                stack.append((less, depth))
    return out


def repeated_strings(keys: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows grouped by ``keys``: the least and the largest s whose string (from s bytes before the anchor on) is repeated.

    ``left`` is the bytes before the anchor, ``right`` those from it on.  Rows without any have a largest s of -1.  ``times``
    says how often a row's bytes occur; all strings of rows that occur twice are repeated.
    """
    m = len(keys)
    low, high = np.full(m, length, np.int64), np.full(m, -1, np.int64)
    for i in np.flatnonzero(times > 1).tolist() if times is not None else ():
        if len(left[i]) + len(right[i]) >= length:
            low[i], high[i] = max(0, length - len(right[i])), len(left[i])
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), m]
    order: list[int] = []
    groups: list[int] = []
    for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b - a > 1:
            own = deep_shallow(list(range(a, b)), right)
            order += own
            groups += [g] * len(own)
    if not order:
        return low, high
    at, group = np.array(order), np.array(groups)
    n_right, n_left = np.array([len(right[i]) for i in order]), np.array([len(left[i]) for i in order])
    r = np.frombuffer(b"".join(right[i].ljust(length, b"\0") for i in order), np.uint8).reshape(len(order), length)
    depth = length - GRAM
    back = np.frombuffer(b"".join(left[i][::-1].ljust(depth, b"\0") for i in order), np.uint8).reshape(len(order), depth)
    differ = r[1:] != r[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    shared = np.minimum(shared, np.minimum(n_right[1:], n_right[:-1]))
    shared[group[1:] != group[:-1]] = -1
    before = np.zeros(len(order), dtype=np.uint64)
    for s in range(depth + 1):
        if s:
            before = (before ^ _BYTE[back[:, s - 1]]) * _ODD[0]
            before ^= before >> np.uint64(32)
        ok = np.flatnonzero((n_left >= s) & (n_right >= length - s))
        if len(ok) < 2:
            continue
        kind = np.concatenate([[0], np.cumsum(shared < length - s)])[ok].astype(np.uint64)
        key = (kind * _ODD[1]) ^ before[ok]
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(ok), dtype=bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit = at[ok[twice]]
        low[hit] = np.minimum(low[hit], s)
        high[hit] = np.maximum(high[hit], s)
    return low, high


def _bytes_of(text: str | None) -> bytes:
    return text.encode() if text else b""


def _counted(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                found = [anchors(np.frombuffer(_bytes_of(t), np.uint8))[1] for t in batch.column(0).slice(lo, 1024).to_pylist()]
                h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return rows.select("text").mapInArrow(tidied(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


_PLACES = "anchor long, doc_id long, text_key long, places array<long>, before binary, after binary, heavy boolean"


def _placed(rows: DataFrame, bitmap: np.ndarray, bits: int, hot: list[int]) -> DataFrame:
    """The anchors that may be repeated, with the bytes around them; of hot anchors, a row for all equal surroundings in a text."""
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, np.array(sorted(hot), dtype=np.int64)))
    depth = LENGTH - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 2 + [pa.bool_()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(7)]
                for doc, key, text in zip(*(c.slice(lo, 256).to_pylist() for c in batch.columns), strict=True):
                    raw = _bytes_of(text)
                    at, h = anchors(np.frombuffer(raw, np.uint8))
                    k = _bit(h.view(np.int64), bits)
                    live = np.flatnonzero((bitmap[k >> 3] >> (k & 7).astype(np.uint8)) & 1)
                    is_hot = np.isin(h[live].view(np.int64), hot)
                    same: dict[tuple[int, bytes, bytes], list[int]] = {}
                    for a, anchor, heavy in zip(at[live].tolist(), h[live].view(np.int64).tolist(), is_hot.tolist(), strict=True):
                        before, after = raw[max(0, a - depth):a], raw[a:a + LENGTH]
                        if heavy:
                            same.setdefault((anchor, before, after), []).append(a)
                        else:
                            for c, v in zip(out, (anchor, doc, key, [a], before, after, False), strict=True):
                                c.append(v)
                    for (anchor, before, after), places in same.items():
                        for c, v in zip(out, (anchor, doc, key, places, before, after, True), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _PLACES.split(", ")])

    return rows.select("doc_id", "text_key", "text").mapInArrow(tidied(run), _PLACES)


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return h & np.int64((1 << bits) - 1)


def _sorted(rows: DataFrame) -> DataFrame:
    """``rows`` (anchor, id, before, after, times) with low and high of ``repeated_strings`` in the place of the bytes; only rows with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table) -> pa.RecordBatch:
            keys, times = table.column("anchor").to_numpy(), table.column("times").to_numpy()
            low, high = repeated_strings(keys, table.column("before").to_pylist(), table.column("after").to_pylist(), times=times)
            hit = np.flatnonzero(high >= 0)
            picked = table.select(["id", "times"]).take(pa.array(hit)).combine_chunks()
            return pa.RecordBatch.from_arrays([_flat(picked.column(0)), _flat(picked.column(1)), pa.array(low[hit]), pa.array(high[hit])], names=["id", "times", "low", "high"])

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                table = pa.Table.from_batches([batch.slice(lo, CHUNK)])
                if rest is not None:
                    table = pa.concat_tables([rest, table])
                keys = table.column("anchor").to_numpy()
                other = np.flatnonzero(keys != keys[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut >= CHUNK // 2:
                    yield found(table.slice(0, cut))
                    table = table.slice(cut)
                rest = table
        if rest is not None and rest.num_rows:
            yield found(rest)

    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "id", "before", "after", "times")
    return ordered.mapInArrow(tidied(run), f"id {kind}, times long, low long, high long")


def _light_spans(places: DataFrame) -> DataFrame:
    """doc_id, text_key, begin, end of what each anchor removes."""
    rows = places.where("not heavy").select(
        "anchor", F.struct("doc_id", "text_key", F.col("places")[0].alias("place")).alias("id"), "before", "after", F.lit(1).cast("long").alias("times"))
    return _sorted(rows).select("id.doc_id", "id.text_key", (F.col("id.place") - F.col("high")).alias("begin"), (F.col("id.place") + LENGTH - F.col("low")).alias("end"))


def _heavy_spans(places: DataFrame) -> DataFrame:
    """The same for hot anchors, whose equal surroundings are counted first."""
    around = F.md5(F.concat(F.col("anchor").cast("string").cast("binary"), F.lit(":").cast("binary"), F.octet_length("before").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("before"), F.col("after")))
    rows = places.where("heavy").withColumn("around", around)
    distinct = rows.groupBy("around").agg(F.first("anchor").alias("anchor"), F.first("before").alias("before"), F.first("after").alias("after"), F.sum(F.size("places")).cast("long").alias("times"))
    answers = _sorted(distinct.select("anchor", F.col("around").alias("id"), "before", "after", "times")).withColumnRenamed("id", "around")
    slim = rows.select("doc_id", "text_key", "places", "around")
    back = attach_groups(slim, persist(answers, "substring-heavy"), "around", "times", slim.count()).where("high is not null")
    ends = F.transform("places", lambda p: F.struct((p - F.col("high")).alias("begin"), (p + LENGTH - F.col("low")).alias("end")))
    return back.select("doc_id", "text_key", F.explode(ends).alias("x")).select("doc_id", "text_key", "x.begin", "x.end")


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, spans (begin, end in bytes; they may overlap) of the rows that lose bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), "text")
    counts = persist(_counted(rows), "substring-anchors")
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
    n, hot = size.n, max(hot, (size.total or 0) // MOST_HOT)
    bits = max(20, min(29, (16 * n).bit_length()))
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    bit = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    for r in bitmap_of(counts, bit, bits).toLocalIterator():  # at most 2^29 bits
        # bucket i holds the values from (i - 1) * 32768 on
        at = (r["_bm_row"] - 1) * 4096
        bitmap[at:at + 4096] = np.frombuffer(r["_bm"], np.uint8)
    common = [r.anchor for r in counts.where(F.col("n") > hot).select("anchor").collect()]  # at most MOST_HOT
    places = persist(_placed(rows, bitmap, bits, common), "substring-places")
    spans = _light_spans(places)
    if common:
        spans = spans.union(_heavy_spans(places))
    return persist(spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "substring-spans")


def remove_repeats(docs: DataFrame, hot: int = HOT, bits: int = 23) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, and the bytes that stay as ``kept``."""
    spans = repeated_spans(docs, hot)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), text_of(docs).cast("binary").alias("raw"))
    named = F.xxhash64("doc_id", "text_key")
    rows = in_bitmap(rows, named, persist(bitmap_of(spans, named, bits), "substring-rows"), "hit", bits)
    zero = F.lit(0).cast("long")
    whole = rows.where("not hit").select(
        "doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("raw").alias("kept"))
    other = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans")
    hit = rows.where("hit").join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "raw", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, parts, sizes = [], [], [], []
            for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in sorted((x["begin"], x["end"]) for x in own or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                at, pieces = 0, []
                for a, b in merged:
                    pieces.append(raw[at:a])
                    at = b
                pieces.append(raw[at:])
                kept.append(b"".join(pieces))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                parts.append(len(merged))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(parts, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.unionByName(hit.mapInArrow(tidied(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, n - 199)) AS t(i) WHERE n >= 200
), dup AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), st AS (
  SELECT doc_id, i FROM w SEMI JOIN dup USING (k)
), b AS (
  SELECT d.doc_id, t.p, substr(h, 2 * t.p + 1, 2) AS c FROM d, unnest(range(0, n)) AS t(p)
), f AS (
  SELECT b.doc_id, b.p, b.c, max(CASE WHEN st.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone
  FROM b LEFT JOIN st ON st.doc_id = b.doc_id AND st.i = b.p
), g AS (
  SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM f
), r AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(c, '' ORDER BY p) FILTER (WHERE gone = 0), '') AS kept
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
