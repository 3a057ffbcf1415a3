"""Language-model scores from class bigrams, classes by exchange clustering of every training word.

Words are counted over all training documents.  The ``known`` most frequent words (a bounded broadcast) go by number, all others
by a 64-bit hash (two words of equal hash would move together; nothing else depends on it).  Classes are made in two steps:

* ``exchange``: the ``moved`` most frequent words go one at a time to the class that raises the likelihood most; bands of falling
  frequency and one class of rare words stand in for the others.
* ``_everywhere``: rounds over the whole vocabulary.  Every word, the rarest too, has the counts of its left and right neighbours'
  classes (those of rare neighbours come as messages through a shuffle) and goes to the best class by the same gain.  The first round
  empties the bands and the rare class.  A round takes the class table as it was at its start, so the result doesn't depend on the
  partitions; a later round that doesn't raise the likelihood is dropped.

    p(w | v) = (1 - unseen(class(v))) * p(class(w) | class(v)) * p(w | class(w))

Transitions are smoothed towards the classes' own frequencies.  ``unseen`` is the share set aside for the one outcome "a word never
seen": how often a word seen once follows that class.  Counts and classes of rare words grow with the input; they are joined by word
and never broadcast.

Defined cases: a null or empty text is its end alone; null doc_ids are hashed as the empty text; repeated rows are
scored one by one (and all train); without training documents nothing is known; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import doc_hash, persist, tidied

KNOWN = 65_536
MOVED = 2_048
CLASSES = 64
ROUNDS = 3
ALL_ROUNDS = 2
BUCKETS, HELD_OUT = 7, 2

#: Bytes of texts that are cut into words together (a longer text stands alone).
SLICE = 4 << 20
#: Tokens whose counts, or documents, leave a task together.
TOKENS = 4_000_000
#: Distinct words that a task counts before they leave it.
WORDS = 300_000


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of about ``SLICE`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in turn with A-Z in lower case, in UTF-8, and the number of each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, lengths = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty word
    if not some.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[some], minlength=len(lengths))
        words = words.filter(pa.array(some))
    return words, lengths.astype(np.int64)


def _looked_up(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The numbers of words among ``known`` ones, or -1; and those that aren't among them."""
    at = pc.index_in(words, value_set=known)
    return at.fill_null(-1).to_numpy().astype(np.int64), words.filter(at.is_null())


def _word_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"]).select(["word", "c"])

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                coded = words_of(texts)[0].dictionary_encode()
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                held.append(pa.table({"word": coded.dictionary, "c": counts}))
                size += len(counts)
                if size > 2 * WORDS:
                    held = [summed()]
                    size = held[0].num_rows
                    if size > WORDS:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from summed().to_batches()

    return train.select("text").mapInArrow(tidied(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _top(counts: DataFrame, known: int) -> list[tuple[bytes, int]]:
    """The ``known`` most frequent words, by count and word.

    How many words have each count (as many rows as the root of twice the tokens at most) shows from which count on words are needed: the
    driver gets few more than ``known`` rows, not so many from each partition, unless very many words share that least count.
    """
    often = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("c", "descending")])
    if not often.num_rows:
        return []
    enough = int(np.searchsorted(np.cumsum(often.column("n").to_numpy()), known))
    least = often.column("c")[min(enough, often.num_rows - 1)].as_py()
    return [(bytes(r.word), r.c) for r in counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(known).collect()]


@dataclass
class Symbols:
    """The numbers that words go by in the first step's counts: moved words, then bands, then rare words, then the end."""

    number: dict[bytes, int]
    moved: int
    bands: int

    @property
    def rare(self) -> int:
        return self.moved + self.bands

    @property
    def end(self) -> int:
        return self.rare + 1


def _symbols(top: list[tuple[bytes, int]], moved: int) -> Symbols:
    number, bands = {}, 0
    moved = min(moved, len(top))
    for i, (w, _) in enumerate(top):
        band = max(0, ((i // moved).bit_length() - 1)) if i >= moved else 0
        number[w] = i if i < moved else moved + band
        bands = max(bands, band + 1 if i >= moved else 0)
    return Symbols(number, moved, bands)


_MIX = np.random.Generator(np.random.PCG64(8)).integers(0, (1 << 64) - 1, (64, 256), dtype=np.uint64, endpoint=True)


def _ids(words: pa.Array | list[bytes]) -> np.ndarray:
    """Negative ids of words outside the known ones, by hash: random numbers for each byte and place, added up."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    if not len(words):
        return np.zeros(0, np.int64)
    offsets, data = _bytes(words)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = _MIX[place & 63, data]
    if len(far := np.flatnonzero(place > 63)):
        mixed[far] *= np.cumprod(np.full(int(place.max() >> 6), _MIX[0, 0] | np.uint64(1)))[(place[far] >> 6) - 1]
    return -1 - (np.add.reduceat(mixed, offsets[:-1]) >> np.uint64(2)).astype(np.int64)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of words."""
    _, at, data = words.buffers()
    offsets = np.frombuffer(at, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)


class _Sums:
    """Sums of ``n`` by ``code``, compressed as they grow."""

    def __init__(self) -> None:
        self.codes, self.n, self.size = [], [], 0

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        self.codes.append(code)
        self.n.append(n)
        self.size += len(code)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All sums by ascending code; nothing is left."""
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(self.n), minlength=len(codes)).astype(np.int64)
        self.codes, self.n, self.size = [], [], 0
        return codes, n

    def full(self, most: int = 1_000_000) -> bool:
        if self.size > 2 * most:
            self.add(*self.taken())
        return self.size > most


#: Most integers of a known word's row, so that a batch of rows stays small.
_RUN = 128


def _runs(key: np.ndarray, values: np.ndarray, each: int = 1, most: int = _RUN) -> pa.RecordBatch:
    """Rows of sorted keys and their values (``each`` for a key), in runs of at most ``most`` keys."""
    start = _starts(key)
    place = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    start = np.flatnonzero(place % most == 0)
    return pa.RecordBatch.from_arrays([pa.array(key[start]), _blobs(values, each * np.diff(np.append(start, len(key))))], names=["key", "near"])


def _neighbours(train: DataFrame, top: pa.Array) -> tuple[DataFrame, DataFrame]:
    """Neighbours over all training texts, of known words and of rare ones.

    Of known words, for both sides: n * 2 size + 2 * other + (1: it follows), in one or more rows.  All rare words share the number
    after the last there; the end of a text has the next one; ``size`` is the number of all these.  Of rare words, one row for each
    id: the words before and after each place in turn, by number or id.
    """
    rare, end, n = len(top), len(top) + 1, len(top) + 2
    shared = train.sparkSession.sparkContext.broadcast(top)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, held, size = shared.value, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([[end], *held])
            held.clear()
            symbol = np.where(flat < 0, rare, flat)
            codes, counts = np.unique(symbol[:-1] * n + symbol[1:], return_counts=True)
            a, b = codes // n, codes % n
            yield _runs(a, counts * 2 * n + 2 * b + 1)
            order = np.argsort(b, kind="stable")
            yield _runs(b[order], (counts * 2 * n + 2 * a)[order])
            at = np.flatnonzero(flat < 0)
            at = at[np.argsort(flat[at], kind="stable")]
            yield _runs(flat[at], np.stack([flat[at - 1], flat[at + 1]], axis=1).ravel(), 2)

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                words, lengths = words_of(texts)
                number, others = _looked_up(words, top)
                coded = others.dictionary_encode()
                number[number < 0] = _ids(coded.dictionary)[coded.indices.to_numpy()]
                ids = np.full(len(number) + len(lengths), end)
                ids[np.arange(len(number)) + np.repeat(np.arange(len(lengths)), lengths)] = number
                held.append(ids)
                size += len(ids)
                if size > TOKENS:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()

        def known() -> pa.RecordBatch:
            codes, counts = sums.taken()
            return _runs(codes // (2 * n), counts * 2 * n + codes % (2 * n))

        for rows in _whole_keys(batches, loose=True):
            key = rows.column(0).to_numpy()
            values, lengths = _flat(rows.column(1))
            if key[0] < 0:
                start = _starts(key)
                yield pa.RecordBatch.from_arrays([pa.array(key[start]), _blobs(values, np.add.reduceat(lengths, start))], names=["key", "near"])
            else:
                sums.add(np.repeat(key, lengths) * 2 * n + values % (2 * n), values // (2 * n))
                if sums.full():
                    yield known()
        yield known()

    kind = "key long, near binary"
    found = train.select("text").mapInArrow(tidied(scan), kind).repartition("key").sortWithinPartitions("key").mapInArrow(tidied(joined), kind)
    found = persist(found, "lm-near")
    return found.where("key >= 0"), found.where("key < 0")


def _bigrams(pairs: DataFrame, symbols: Symbols, symbol: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols, as a matrix whose size the symbols fix."""
    shared, n, size = pairs.sparkSession.sparkContext.broadcast(symbol), symbols.end + 1, len(symbol)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, sums = shared.value, _Sums()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums.taken()], names=["code", "n"])

        for batch in batches:
            values, lengths = _flat(batch.column(1))
            key, use = np.repeat(batch.column(0).to_numpy(), lengths), values & 1 == 1
            sums.add(symbol[key[use]] * n + symbol[values[use] % (2 * size) >> 1], values[use] // (2 * size))
            if sums.full():
                yield out()
        yield out()

    table = pairs.mapInArrow(tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n, dtype=np.float64)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(n, n)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _whole_keys(batches: Iterator[pa.RecordBatch], loose: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut only where it changes; ``loose``: known words may be cut, and come apart from rare ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if loose:
            cut = int(np.searchsorted(batch.column(0).to_numpy(), 0))
            if cut < batch.num_rows:
                if cut:
                    held = [*held, batch.slice(0, cut)]
                if held:
                    yield _one(held)
                    held = []
                yield batch.slice(cut)
                continue
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield _one(held)
            held = []
        last = int(_starts(key)[-1])
        if last:
            yield _one([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of integers as binary values."""
    offsets = np.concatenate([[0], np.cumsum(lengths) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all values of ``_blobs``, and the length of each; nulls are empty."""
    _, at, data = column.buffers()
    offsets, each = np.frombuffer(at, np.int32)[column.offset:column.offset + len(column) + 1], np.dtype(kind).itemsize
    size = int(offsets[-1] - offsets[0]) // each
    return np.frombuffer(data, kind, size, int(offsets[0])) if size else np.zeros(0, kind), np.diff(offsets) // each


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, moved: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol: the first ``moved`` ones clustered, each of the others a class of its own."""
    n = len(bigrams)
    classes = max(1, min(classes, moved))
    own = np.concatenate([np.arange(moved) % classes, classes + np.arange(n - moved)]).astype(np.int64)
    k = classes + n - moved
    table = np.zeros((k, k))
    np.add.at(table, (own[:, None].repeat(n, 1), own[None, :].repeat(n, 0)), bigrams)
    for _ in range(rounds):
        changes = 0
        for w in range(moved):
            right = np.bincount(own, weights=bigrams[w], minlength=k)
            left = np.bincount(own, weights=bigrams[:, w], minlength=k)
            a, self_n = own[w], bigrams[w, w]
            right[a] -= self_n
            left[a] -= self_n
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= self_n
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            part = table[:classes]
            gain = (_f(part + right) - _f(part)).sum(axis=1)
            part = table[:, :classes]
            gain += (_f(part + left[:, None]) - _f(part)).sum(axis=0)
            d = np.arange(classes)
            diag = table[d, d]
            gain += _f(diag + right[d] + left[d] + self_n) - _f(diag + right[d]) - _f(diag + left[d]) + _f(diag)
            r_all, l_all = right.sum() + self_n, left.sum() + self_n
            gain -= _f(rows[:classes] + r_all) - _f(rows[:classes]) + _f(columns[:classes] + l_all) - _f(columns[:classes])
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 and a < classes:
                b = int(a)
            changes += b != a
            own[w] = b
            table[b, :] += right
            table[:, b] += left
            table[b, b] += self_n
        if not changes:
            break
    return own


# Counts of a word's neighbours by class are packed in 64-bit integers n * (2 k + 1) + code.  Codes: the class that follows, k + the
# class before, 2 k for the word itself (counted once; not among the others).
_ROW = "key long, own int, near binary, around binary"
_NAMES = ["key", "own", "near", "around"]


def _rows(key: np.ndarray, own: np.ndarray | None, near: pa.Array | None, around: pa.Array | None) -> pa.RecordBatch:
    n = len(key)
    columns = [pa.array(key, pa.int64()), pa.nulls(n, pa.int32()) if own is None else pa.array(own, pa.int32())]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(n, pa.binary()) if x is None else x for x in (near, around)], names=_NAMES)


def _packed(sums: _Sums, base: int) -> pa.RecordBatch:
    """Sums by key * base + code as rows of packed counts."""
    codes, n = sums.taken()
    key = codes // base
    start = _starts(key)
    return _rows(key[start], None, None, _blobs(n * base + codes % base, np.diff(np.append(start, len(key)))))


def _known_around(pairs: DataFrame, own: np.ndarray, k: int, with_rare: bool) -> DataFrame:
    """Counts of the neighbours of known words by class; those of rare neighbours only where they are in one class."""
    shared, rare, base, size = pairs.sparkSession.sparkContext.broadcast(own), len(own) - 2, 2 * k + 1, len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value, _Sums()
        for batch in batches:
            values, lengths = _flat(batch.column(1))
            key, other, n = np.repeat(batch.column(0).to_numpy(), lengths), values % (2 * size), values // (2 * size)
            follows, other = other & 1, other >> 1
            code = np.where(other == key, 2 * k, np.where(follows == 1, 0, k) + own[other])
            use = (key != rare) & ((other != key) | (follows == 1)) & (with_rare | (other != rare))
            sums.add((key * base + code)[use], n[use])
            if sums.full():
                yield _packed(sums, base)
        yield _packed(sums, base)

    return pairs.mapInArrow(tidied(run), _ROW)


def _gathered(rows: DataFrame, own: np.ndarray, k: int, rare: int | None = None) -> DataFrame:
    """One row for each key, from rows sorted by key: its class and the counts of its neighbours by class.

    Neighbours that are rare words have sent their classes, unless all are in the class ``rare``.
    """
    shared, base = rows.sparkSession.sparkContext.broadcast(own), 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in _whole_keys(batches):
            key, sent = batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy()
            start = _starts(key)
            at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            packed, lengths = _flat(batch.column(3))
            codes, counts = [np.repeat(at, lengths) * base + packed % base], [packed // base]
            near, lengths = _flat(batch.column(2))
            lengths = lengths // 2
            for other, side in ((near[::2], k), (near[1::2], 0)):
                itself, known = other == np.repeat(key, lengths), other >= 0
                code = np.where(itself, 2 * k, side + np.where(known, own[np.where(known, other, 0)], rare or 0))
                use = (known & ~itself) | (itself & (side == 0)) | (~known & ~itself & (rare is not None))
                codes.append((np.repeat(at, lengths) * base + code)[use])
                counts.append(np.ones(int(use.sum()), np.int64))
            sums = np.bincount(np.concatenate(codes), weights=np.concatenate(counts), minlength=len(start) * base).astype(np.int64)
            some = np.flatnonzero(sums)
            around = _blobs(sums[some] * base + some % base, np.bincount(some // base, minlength=len(start)))
            origin = np.full(len(start), -1)
            self_rows = np.flatnonzero((sent >= 0) & (key < 0))
            origin[at[self_rows]] = self_rows
            take = pa.array(origin, mask=origin < 0)
            key = key[start]
            new = np.where(key >= 0, own[np.maximum(key, 0)], sent[origin])
            yield _rows(key, new, batch.column(2).take(take), around)

    return rows.mapInArrow(tidied(run), _ROW)


class Gains:
    """The best class of words by exchange gain against one table of class bigrams.

    Words of one class with the same few small counts go the same way and are weighed once (``seen``, bounded).
    """

    SMALL, TIMES, ENTRIES, SEEN = 8, 64, 16_384, 500_000

    def __init__(self, table: np.ndarray, classes: int) -> None:
        self.table, self.classes, self.k = table, classes, len(table)
        self.cells = np.concatenate([table[:classes].T, table[:, :classes]])
        self.small = np.stack([_f(self.cells + n) - _f(self.cells) for n in range(1, self.SMALL + 1)])
        self.rows, self.columns = table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]
        self.often = [np.stack([_f(x + n) - _f(x) for n in range(self.TIMES + 1)]) for x in (self.rows, self.columns)]
        self.diagonal = np.diagonal(table)[:classes]
        self.seen = np.zeros((2, 0), np.int64)

    def best(self, own: np.ndarray, packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The class of each word; its ``own`` if none is better."""
        out, ends = np.array(own, dtype=np.int64), np.cumsum(lengths)
        least = (2 * self.k + 1) * (self.SMALL + 1)
        bits = least.bit_length()
        most = (62 - self.k.bit_length()) // bits
        large = np.bincount(np.repeat(np.arange(len(out)), lengths)[packed >= least], minlength=len(out))
        alike = np.flatnonzero((lengths <= most) & (large == 0))
        sign = out[alike]
        for i in range(most):
            there = lengths[alike] > i
            sign = sign << bits
            sign[there] |= packed[(ends - lengths)[alike][there] + i]
        sign, first, at = np.unique(sign, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.seen[0], sign), max(0, self.seen.shape[1] - 1))
        new = self.seen[0][place] != sign if self.seen.shape[1] else np.ones(len(sign), bool)
        rest = np.ones(len(out), bool)
        rest[alike] = False
        rest[alike[first[new]]] = True
        rest = np.flatnonzero(rest)
        entry = np.arange(int(lengths[rest].sum())) + np.repeat((ends - lengths)[rest] - (np.cumsum(lengths[rest]) - lengths[rest]), lengths[rest])
        out[rest] = self._all(out[rest], packed[entry], lengths[rest])
        found = out[alike[first]]
        if self.seen.shape[1]:
            found = np.where(new, found, self.seen[1][place])
        out[alike] = found[at]
        if self.seen.shape[1] < self.SEEN:
            both = np.concatenate([self.seen, np.stack([sign, found])[:, new]], axis=1)
            self.seen = both[:, np.argsort(both[0], kind="stable")]
        return out

    def _all(self, own: np.ndarray, packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, ends = own.copy(), np.cumsum(lengths)
        lo = 0
        while lo < len(out):
            begin = int(ends[lo] - lengths[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, begin + self.ENTRIES, "right")))
            out[lo:hi] = self._part(out[lo:hi], packed[begin:ends[hi - 1]], lengths[lo:hi])
            lo = hi
        return out

    def _part(self, own: np.ndarray, packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        c, k, base, m = self.classes, self.k, 2 * self.k + 1, len(own)
        word, code, n = np.repeat(np.arange(m), lengths), packed % base, packed // base
        dense = np.bincount(word * base + code, weights=n, minlength=m * base).reshape(m, base)
        right, left, self_n = dense[:, :k], dense[:, k:2 * k], dense[:, 2 * k]
        other = code < 2 * k
        word, code, n = word[other], code[other], n[other].astype(float)
        a = own[word]

        few = n <= self.SMALL
        if few.all():
            gains = self.small[n.astype(int) - 1, code]
        else:
            gains = np.empty((len(code), c))
            gains[few] = self.small[n[few].astype(int) - 1, code[few]]
            full = np.flatnonzero(~few)
            gains[full] = _f(self.cells[code[full]] + n[full, None]) - _f(self.cells[code[full]])
        # What the word itself has put into the table is taken out: pairs with neighbours of its own class, and its own class's cells.
        same = np.flatnonzero(code % k == a)
        back = np.where((code[same] < k)[:, None], left[word[same], :c], right[word[same], :c])
        cells = self.cells[code[same]] - back
        at = np.flatnonzero(a[same] < c)
        cells[at, a[same][at]] -= n[same][at] + self_n[word[same][at]]
        gains[same] = _f(cells + n[same, None]) - _f(cells)
        at = np.flatnonzero((code % k != a) & (a < c))
        cell = self.cells[code[at], a[at]] - n[at]
        gains[at, a[at]] = _f(cell + n[at]) - _f(cell)

        total = np.zeros((m, c))
        starts = _starts(word)
        total[word[starts]] = np.add.reduceat(gains, starts, axis=0) if len(starts) else 0
        at = np.flatnonzero(own < c)
        for side, all_, often in ((right, self.rows, self.often[0]), (left, self.columns, self.often[1])):
            times = side.sum(axis=1) + self_n
            less = often[np.minimum(times, self.TIMES).astype(int)]
            many = np.flatnonzero(times > self.TIMES)
            less[many] = _f(all_ + times[many, None]) - _f(all_)
            less[at, own[at]] = _f(all_[own[at]]) - _f(all_[own[at]] - times[at])
            total -= less
        # Pairs within the class: all classes of a word that follows itself, else those on both of its sides.
        w, b = np.nonzero(((right[:, :c] > 0) & (left[:, :c] > 0)) | (self_n > 0)[:, None])
        r, l, s = right[w, b], left[w, b], self_n[w]  # noqa: E741
        diagonal = self.diagonal[b] - np.where(b == own[w], r + l + s, 0)
        total[w, b] += _f(diagonal + r + l + s) - _f(diagonal + r) - _f(diagonal + l) + _f(diagonal)
        b = np.argmax(total, axis=1)
        stay = (own < c) & (total[np.arange(m), b] <= total[np.arange(m), np.minimum(own, c - 1)] + 1e-9)
        return np.where(stay, own, b)


def _best_known(known: DataFrame, own: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """The classes of the known words after a round; the end of a text keeps its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(table, classes)
        for batch in batches:
            new = gains.best(batch.column(1).to_numpy(), *_flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.int32())], names=["key", "own"])

    moved = known.where(F.col("key") < len(own) - 2).select("key", "own", "around").mapInArrow(tidied(run), "key long, own int").toArrow()
    out = own.copy()
    out[moved.column("key").to_numpy()] = moved.column("own").to_numpy()
    return out


def _best_rare(rare: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """The rare words with their classes after a round, and what they tell their neighbours."""
    k = len(table)
    base = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, sums = Gains(table, classes), _Sums()
        for batch in batches:
            key = batch.column(0).to_numpy()
            new = gains.best(batch.column(1).to_numpy(), *_flat(batch.column(3)))
            yield _rows(key, new, batch.column(2), None)
            near, lengths = _flat(batch.column(2))
            lengths = lengths // 2
            for other, side in ((near[::2], 0), (near[1::2], k)):
                code, itself = np.repeat(side + new, lengths), np.repeat(key, lengths)
                known = other >= 0
                sums.add(other[known] * base + code[known], np.ones(int(known.sum()), np.int64))
                at = np.flatnonzero(~known & (other != itself))
                if len(at):
                    yield _rows(other[at], None, None, _blobs(base + code[at], np.ones(len(at), np.int64)))
            if sums.full():
                yield _packed(sums, base)
        yield _packed(sums, base)

    return rare.mapInArrow(tidied(run), _ROW)


def _tables(state: DataFrame, k: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams; and of the words seen once, by class: how many follow it, it follows, and are in it."""
    base = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, once = np.zeros(k * k), np.zeros(3 * k)
        for batch in batches:
            key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            packed, lengths = _flat(batch.column(2))
            word, code, n = np.repeat(np.arange(len(key)), lengths), packed % base, packed // base
            a, after = own[word], (code < k) | (code == 2 * k)
            table += np.bincount((a * k + np.where(code == 2 * k, a, code % k))[after], weights=n[after], minlength=k * k)
            single = (np.bincount(word[after], weights=n[after], minlength=len(key)) == 1) & (key != end)
            use = single[word] & (code < 2 * k)
            once[:2 * k] += np.bincount(np.where(code < k, k, 0)[use] + code[use] % k, minlength=2 * k)
            once[2 * k:] += np.bincount(own[single], minlength=k)
        both = np.concatenate([table, once]).astype(np.int64)
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some])], names=["code", "n"])

    found = state.select("key", "own", "around").mapInArrow(tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k + 3 * k)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out[:k * k].reshape(k, k), out[k * k:].reshape(3, k)


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood of the training texts that depends on the classes."""
    return float(_f(table).sum() - _f(table.sum(axis=1)).sum() - _f(table.sum(axis=0)).sum())


def _everywhere(
    pairs: DataFrame, places: DataFrame, own: np.ndarray, table: np.ndarray, classes: int, rounds: int,
) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Every word to its best class, in rounds: the state of all words, the known words' classes, class bigrams, words seen once."""
    k, rare = len(table), int(own[-2])
    known = _gathered(_known_around(pairs, own, k, True).repartition("key").sortWithinPartitions("key"), own, k, rare)
    alone = places.select("key", F.lit(rare).alias("own"), "near", F.lit(None).cast("binary").alias("around"))
    others = _gathered(alone, own, k, rare)
    kept: tuple | None = None
    for _ in range(max(1, rounds)):
        new = _best_known(known, own, table, classes)
        sent = _best_rare(others, table, classes).unionByName(_known_around(pairs, new, k, False))
        state = persist(_gathered(sent.repartition("key").sortWithinPartitions("key"), new, k), "lm-classes")
        table, once = _tables(state, k, len(own) - 1)
        if kept and likelihood(table) <= likelihood(kept[2]):
            break
        own, kept = new, (state, new, table, once)
        known, others = state.where("key >= 0"), state.where("key < 0")
    return kept


def word_classes(
    train: DataFrame, top: list[tuple[bytes, int]], moved: int, classes: int, rounds: int,
) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``_everywhere``, from the first step on, and the number of classes."""
    symbols = _symbols(top, moved)
    symbol = np.array([*[symbols.number[w] for w, _ in top], symbols.rare, symbols.end], dtype=np.int64)
    pairs, places = _neighbours(train, pa.array([w for w, _ in top], pa.binary()))
    bigrams = _bigrams(pairs, symbols, symbol)
    own = exchange(bigrams, symbols.moved, classes)
    k, classes = int(own.max()) + 1, max(1, min(classes, symbols.moved))
    table = np.zeros((k, k))
    np.add.at(table, (own[:, None].repeat(len(own), 1), own[None, :].repeat(len(own), 0)), bigrams)
    return *_everywhere(pairs, places, own[symbol], table, classes, rounds), classes


def transitions(table: np.ndarray, once: np.ndarray, classes: int, end: int, n: int) -> np.ndarray:
    """log10 of a class after a class; the end of a text comes after the classes of words, and after it words never seen."""
    use = np.array([*range(classes), end])
    table, once = table[np.ix_(use, use)], once[:, use]
    follow, after, within = once
    some = table.sum(axis=0) > 0
    some[-1] = True
    single = np.where(some, table.sum(axis=0) + 1, 0.0)
    single /= single.sum()
    apart = (within.sum() + 0.5) / (n + 1)
    rows, size = table.sum(axis=1), max(1.0, after.sum())
    unseen = (follow + 5 * apart) / (rows + 5)
    # Whether the word after a word seen once was itself seen once is taken from its class.
    share = ((after * within / np.maximum(1, rows)).sum() + 5 * apart) / (size + 5)
    p = np.zeros((classes + 2, classes + 2))
    p[:-1, :-1] = (table + 5 * single) / (rows[:, None] + 5) * (1 - unseen[:, None])
    p[:-1, -1] = unseen
    p[-1, :-1] = (after + 5 * single) / (after.sum() + 5) * (1 - share)
    p[-1, -1] = share
    return np.log10(np.maximum(p, 1e-300))


#: Rows in which words are looked up: of classes (``sid`` -2; ids in turn with classes in ``n``), counts (-1; in ``n``), and words of group
#: ``sid`` (their places there in ``n``); ``words`` one behind the other, of ``sizes`` bytes each.
_LOOK = "part int, sid long, words binary, sizes binary, n binary"


def _dealt(parts: int, sid: int, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Words and their numbers, in a row for each part that has some."""
    part = (-1 - _ids(words)) % parts
    order = np.argsort(part, kind="stable")
    part, (offsets, data) = part[order], _bytes(words.take(pa.array(order)))
    start = _starts(part)
    many = np.diff(np.append(start, len(part)))
    cells = pa.py_buffer(offsets[np.append(start, len(part))].astype(np.int32))
    columns = [pa.array(part[start], pa.int32()), pa.array(np.full(len(start), sid)), pa.Array.from_buffers(pa.binary(), len(start), [None, cells, pa.py_buffer(data)])]
    return pa.RecordBatch.from_arrays([*columns, _blobs(np.diff(offsets).astype(np.int32), many), _blobs(n[order], many)], names=["part", "sid", "words", "sizes", "n"])


def _words(data: pa.Array, sizes: pa.Array) -> pa.Array:
    """The words of rows of ``_dealt``."""
    lengths = _flat(sizes, np.int32)[0]
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(np.ascontiguousarray(_bytes(data)[1]))])


def _rare_words(counts: DataFrame, top: list[tuple[bytes, int]], state: DataFrame, parts: int) -> DataFrame:
    """Counts and classes of the words that aren't among the known ones, dealt to parts."""
    rest = counts
    if top:
        last, least = top[-1]
        rest = counts.where((F.col("c") < least) | ((F.col("c") == least) & (F.col("word") > F.lit(bytearray(last)))))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered_up(batches):
            yield _dealt(parts, -1, rows.column(0), rows.column(1).to_numpy())

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered_up(batches):
            key, own = (c.to_numpy().astype(np.int64) for c in rows.columns)
            part = (-1 - key) % parts
            order = np.argsort(part, kind="stable")
            start = _starts(part[order])
            n = _blobs(np.stack([key, own], axis=1)[order].ravel(), 2 * np.diff(np.append(start, len(part))))
            none = pa.nulls(len(start), pa.binary())
            columns = [pa.array(part[order][start], pa.int32()), pa.array(np.full(len(start), -2)), none, none, n]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "sid", "words", "sizes", "n"])

    classes = state.where("key < 0").select("key", "own").mapInArrow(tidied(classed), _LOOK)
    return rest.select("word", "c").mapInArrow(tidied(counted), _LOOK).unionByName(classes)


def _gathered_up(batches: Iterator[pa.RecordBatch], most: int = WORDS) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``most`` rows, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield _one(held)
            held, size = [], 0
    if size:
        yield _one(held)


def _answers(rows: DataFrame, classes: int) -> DataFrame:
    """Of each group's words: their places in turn with count * (classes + 2) + class; words never seen have count 0 and a class of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            begin = np.append(_starts(batch.column(0).to_numpy()), batch.num_rows)
            for lo, hi in zip(begin.tolist(), begin[1:].tolist(), strict=False):
                part = batch.slice(lo, hi - lo)
                _, counted, asked = np.split(np.arange(hi - lo), np.searchsorted(part.column(1).to_numpy(), [-1, 0]))
                if not len(asked):
                    continue
                states, seen, rest = (part.slice(int(x[0]) if len(x) else 0, len(x)) for x in (_, counted, asked))
                words, n = _words(seen.column(2), seen.column(3)), _flat(seen.column(4))[0]
                pairs = _flat(states.column(4))[0].reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0])]
                own = pairs[np.searchsorted(pairs[:, 0], _ids(words)), 1]
                at, lengths = _flat(rest.column(4))
                found = pc.index_in(_words(rest.column(2), rest.column(3)), value_set=words).fill_null(len(words)).to_numpy()
                told = np.append(n * (classes + 2) + own, classes + 1)[found]
                yield pa.RecordBatch.from_arrays([rest.column(1), _blobs(np.stack([at, told], axis=1).ravel(), 2 * lengths)], names=["sid", "told"])

    return rows.repartition("part").sortWithinPartitions("part", "sid").mapInArrow(tidied(run), "sid long, told binary")


_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double"


def scores(
    docs: DataFrame, known: int = KNOWN, moved: int = MOVED, classes: int = CLASSES, buckets: int = BUCKETS, held_out: int = HELD_OUT,
    all_rounds: int = ALL_ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(doc_hash(), F.lit(buckets)) == held_out).alias("held_out"), "text")
    train = rows.where("not held_out")
    counts = persist(_word_counts(train), "lm-counts")
    n_docs = train.count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total.n or 0) + n_docs, total.v + (n_docs > 0)

    top = _top(counts, known)
    state, own, table, once, classes = word_classes(train, top, moved, classes, all_rounds)
    step = transitions(table, once, classes, int(own[-1]), n)
    in_class = table.sum(axis=1)
    times, of = np.array([c for _, c in top], dtype=np.float64), own[:len(top)]
    info = (pa.array([w for w, _ in top], pa.binary()), of, np.log10(times / in_class[of]), np.log10((times + 1) / (n + v + 1)))
    shared = spark.sparkContext.broadcast(info)
    end_base = float(np.log10((n_docs + 1) / (n + v + 1)))
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n >> 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with what known words give, and of the other words of groups of documents; ``steps``: a << 32 | b."""
        top, own, emit, base_of = shared.value
        sid, end, held, size = TaskContext.get().partitionId() << 32, classes, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, held_out, found, others, lengths = zip(*held, strict=True)
            number, n_words = np.concatenate(found), np.concatenate(lengths)
            many, known = len(n_words), number >= 0
            coded = pa.concat_arrays(others).dictionary_encode()
            doc = np.repeat(np.arange(many), n_words)
            path = np.full(len(number) + many + 1, end)
            place = np.arange(len(number)) + doc + 1
            path[place[known]] = own[number[known]]
            path[place[~known]] = -1 - coded.indices.to_numpy().astype(np.int64)
            a, b, at = path[:-1], path[1:], np.repeat(np.arange(many), n_words + 1)
            closed = (a >= 0) & (b >= 0)
            of_known = doc[known]
            log = np.bincount(at[closed], step[a[closed], b[closed]], many) + np.bincount(of_known, emit[number[known]], many)
            base = np.bincount(of_known, base_of[number[known]], many) + end_base
            steps = _blobs((a[~closed] << 32) | (b[~closed] & 0xFFFFFFFF), np.bincount(at[~closed], minlength=many))
            columns = [pa.concat_arrays(ids), pa.concat_arrays(held_out), *[pa.array(x) for x in (n_words + 1, np.bincount(of_known, minlength=many) + (n_docs > 0), base, log)], steps]
            yield made(columns, pa.array(np.full(many, sid)), None)
            if len(coded.dictionary):
                look = _dealt(parts, sid, coded.dictionary, np.arange(len(coded.dictionary)))
                yield made(None, look.column(1), look)
            held.clear()

        for batch in batches:
            for lo, texts in _slices(batch.column(2)):
                words, lengths = words_of(texts)
                held.append((batch.column(0).slice(lo, len(texts)), batch.column(1).slice(lo, len(texts)), *_looked_up(words, top), lengths))
                size += len(words)
                if size > TOKENS // 2:
                    yield from out()
                    sid, size = sid + 1, 0
        if held:
            yield from out()

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    schema = f"sid long, {_DOC}, steps binary, part int, words binary, sizes binary, n binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def made(doc: list[pa.Array] | None, sid: pa.Array, look: pa.RecordBatch | None) -> pa.RecordBatch:
        doc = doc or [pa.nulls(len(sid), kind) for kind in kinds]
        more = [look.column(i) for i in (0, 2, 3, 4)] if look else [pa.nulls(len(sid), kind) for kind in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([sid, *doc, *more], names=names)

    scored = persist(rows.mapInArrow(tidied(run), schema), "lm-scored")
    look = scored.where("part is not null").select("part", "sid", "words", "sizes", "n").unionByName(_rare_words(counts, top, state, parts))
    told = _answers(look, classes)
    both = scored.where("part is null").select("sid", *names[1:8]).unionByName(told, allowMissingColumns=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add what the words that had to be looked up give."""
        for batch in _whole_keys(batches):
            begin = np.append(_starts(batch.column(0).to_numpy()), batch.num_rows)
            for lo, hi in zip(begin.tolist(), begin[1:].tolist(), strict=False):
                group = batch.slice(lo, hi - lo)
                is_doc = pc.is_valid(group.column(3))
                doc, told = group.filter(is_doc), group.filter(pc.invert(is_doc))
                pairs = _flat(told.column(8))[0].reshape(-1, 2)
                word = np.empty(len(pairs), np.int64)
                word[pairs[:, 0]] = pairs[:, 1]
                c, own = word // (classes + 2), word % (classes + 2)
                emit = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(1.0, in_class[np.where(c > 0, own, 0)])), 0.0)
                steps, lengths = _flat(doc.column(7))
                at, many = np.repeat(np.arange(doc.num_rows), lengths), doc.num_rows
                a, b = steps >> 32, (steps & 0xFFFFFFFF).astype(np.uint32).view(np.int32).astype(np.int64)
                use = a < 0  # each such word is the first of one step
                rare, of = -1 - a[use], at[use]
                a, b = (np.where(x < 0, own[np.where(x < 0, -1 - x, 0)], x) if len(own) else x for x in (a, b))
                n_known, base, log = (doc.column(i).to_numpy() for i in (4, 5, 6))
                out = [n_known + np.bincount(of, c[rare] > 0, many).astype(np.int64), np.full(many, n), base + np.bincount(of, np.log10((c + 1) / (n + v + 1))[rare], many),
                       log + np.bincount(at, step[a, b], many) + np.bincount(of, emit[rare], many)]
                yield pa.RecordBatch.from_arrays([*doc.columns[1:4], *[pa.array(x) for x in out]], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition("sid").sortWithinPartitions("sid").mapInArrow(tidied(finish), kind)
