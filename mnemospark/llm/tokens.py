"""Byte-level BPE ids of whole texts, through the tokenizers library.

``Encoder`` runs inside Python workers.  For a byte-level BPE with the usual word pattern no token spans the border
between a character that isn't white space and a space or line end, so the texts of a slice (of bounded bytes) are cut into
words, the pre-tokens of the distinct words that are new go through the library in a few native calls, and every text's ids
are gathered from those of its words.  The words of earlier slices are kept up to a bound.  A text, or tokenizer, for which that doesn't hold is
given to the library whole.  The tokenizer's file is read on the driver and broadcast (checked size).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

from mnemospark.llm.common import give_back, held

MAX_FILE = 64 << 20
#: Characters of the texts that are cut into words together (a longer text stands alone), and words in one native call.
SLICE_CHARS = 2 << 20
CALL_WORDS = 20_000
#: A longer text goes to the library whole.
MAX_TEXT = 64 << 20
#: Words whose ids a worker keeps at most; beyond, those that no later slice has asked for since the last time go.
CACHE_WORDS = 300_000

#: The pattern of pre-tokens inside a word; it is used up to U+024F, where all tables of letters and digits agree.
_pretoken = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
_beyond = re.compile("[\u0250-\U0010ffff]")
_unsafe = re.compile(r"[\s\x1c-\x1f] |[^\S\n ]|[\x1c-\x1f]|\n\s")


def _uneven(text: str) -> bool:
    """Whether ``text`` has a zero character or white space other than single spaces and newlines; printable characters include no other."""
    if "\0" in text or "  " in text or "\n " in text or "\n\n" in text:
        return True
    return not text.replace("\n", " ").isprintable() and _unsafe.search(text) is not None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(spark: SparkSession, path: str | None) -> Broadcast:
    """The tokenizer's file, broadcast; refused when it isn't the size of a tokenizer."""
    with open(path or default_tokenizer(), encoding="utf-8") as f:
        text = f.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"the tokenizer's file is larger than {MAX_FILE} bytes")
    return spark.sparkContext.broadcast(text)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else the next above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def slices(texts: pa.Array, most: int = SLICE_CHARS, rows: int = 4096) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about ``most`` characters and at most ``rows`` rows; null is the empty text."""
    n = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < len(texts):
        hi = min(max(lo + 1, int(np.searchsorted(n, n[lo] + most, side="right")) - 1), lo + rows)
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        give_back()  # a slice's arrays are gone by now
        lo = hi


def encoder(spec: Broadcast, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for ``spec``: made once, with its words, for all tasks of the stage that the worker runs."""
    key = (hash(spec.value), special_as_text)
    if key not in held:
        held.clear()
        held[key] = Encoder(spec.value, special_as_text)
    return held[key]


class Words:
    """Ids of the words seen so far: their names, one array of ids, and each word's place in it.  The first ``always`` stay."""

    def __init__(self, names: list[str], ids: np.ndarray, counts: np.ndarray):
        self.names, self.ids, self.counts, self.always = pa.array(names, pa.string()), ids, counts, len(names)
        self.starts, self.used = np.cumsum(counts) - counts, np.zeros(len(names), bool)

    def find(self, names: pa.Array, since: int = 0) -> np.ndarray:
        """The numbers of ``names``, from ``since`` on; -1 for those that aren't here."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names.slice(since)), -1).to_numpy().astype(np.int64)
        return at + since * (at >= 0)

    def add(self, names: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(names), bool)])

    def trim(self, most: int) -> None:
        """Past ``most`` words, keep those used again since the last time (none, if they are too many themselves)."""
        if len(self.names) <= most:
            return
        if self.used.sum() > most * 3 // 4:
            self.used[:] = False
        self.used[:self.always] = True
        keep = np.flatnonzero(self.used)
        self.ids, self.counts = self.ids[_ranges(self.starts[keep], self.counts[keep])], self.counts[keep]
        self.names, self.starts, self.used = self.names.take(pa.array(keep)), np.cumsum(self.counts) - self.counts, np.zeros(len(keep), bool)


def _strings(names: pa.Array) -> list[str]:
    """``names``, none of which has a space, as Python strings."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), " ")[0].as_py().split(" ") if len(names) else []


class Encoder:
    def __init__(self, spec: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        plan = json.loads(spec)
        pre = plan.get("pre_tokenizer") or {}
        self.by_word = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and plan.get("normalizer") is None and plan["model"].get("type") == "BPE"
            and not plan["model"].get("dropout") and not plan["model"].get("continuing_subword_prefix")
            and not plan["model"].get("end_of_word_suffix"))
        self.special = None
        if not special_as_text and (found := [re.escape(t["content"]) for t in plan.get("added_tokens", [])]):
            self.special = re.compile("|".join(found))
        if self.by_word:
            # the same model alone, for pre-tokens in the stand-ins of their bytes
            self.model = Tokenizer(self.tokenizer.model)
            self.model.model._resize_cache(0)
            self.letters = _byte_letters()
            self.line = self.letters[10]
            vocab = self.model.get_vocab()
            self.sizes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            self.sizes[list(vocab.values())] = [len(t) for t in vocab]
            marks = "\n .,;:!?"
            self.marks, self.blank = {c: "\0" + c for c in marks if c > " "}, "\0\0"
            ids = [self.whole(c) for c in marks]
            self.words = Words([self.blank if c == " " else "\0" + c for c in marks], np.concatenate(ids), np.array(list(map(len, ids))))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The words' numbers in ``self.words``; those that it hasn't are encoded first.

        A word follows a space, or stands at the start of a line if it begins with the line end.  ``self.words`` also has
        pre-tokens: by their name if they follow a space, with a mark before it if they don't.
        """
        found = self.words.find(words)
        miss, before = np.flatnonzero(found < 0), len(self.words.names)
        if len(miss):
            new = words.take(pa.array(miss))
            self._learn(_strings(new))
            found[miss] = self.words.find(new, before)
        return found

    def _learn(self, new: list[str]) -> None:
        since, plain = len(self.words.names), [w for w in new if w.isalpha()]
        self._native(plain, True)
        rest = [w for w in new if not w.isalpha()]
        keys: list[str] = []
        sizes: list[int] = []
        marks, add = self.marks, keys.append
        for w in rest:
            before = len(keys)
            if w[-1:] in marks and w[:-1].isalpha():  # a word and one of the usual marks
                add(w[:-1])
                add(marks[w[-1]])
            elif not w:
                add(self.blank)
            elif w[0] == "\n":
                add("\0\n")
                keys.extend(["\0" + x for x in self._pretokens(w[1:])])
            else:
                keys.extend([x[1:] if x[0] == " " else "\0" + x for x in self._pretokens(" " + w)])
            sizes.append(len(keys) - before)
        if not rest:
            return
        coded = pa.array(keys, pa.string()).dictionary_encode()
        numbers = self.words.find(coded.dictionary)
        miss = np.flatnonzero(numbers < 0)
        unknown = coded.dictionary.take(pa.array(miss))
        texts = _strings(unknown)
        self._native([k for k in texts if k[0] != "\0"], True)
        self._native([k for k in texts if k[0] == "\0"], False)
        numbers[miss] = self.words.find(unknown, since)
        which = numbers[coded.indices.to_numpy()]
        counts, total = self.words.counts[which], np.cumsum(self.words.counts[which])[np.cumsum(sizes) - 1]
        names = pa.array(rest, pa.string())
        known = self.words.find(names, since)  # a word that is one pre-token is here already
        if (known >= 0).any():
            first = np.cumsum(sizes) - sizes
            at = np.flatnonzero(known < 0)
            names, sizes_ = names.take(pa.array(at)), np.array(sizes)[at]
            which = which[_ranges(first[at], sizes_)]
            counts, total = self.words.counts[which], np.cumsum(self.words.counts[which])[np.cumsum(sizes_) - 1]
        if len(names):
            self.words.add(names, self.words.ids[_ranges(self.words.starts[which], counts)], np.diff(total, prepend=0))

    def _native(self, names: list[str], after_space: bool) -> None:
        """Encode pre-tokens (after a space, or without the mark before their names); a pre-token's ids are those that cover its bytes."""
        for lo in range(0, len(names), CALL_WORDS):
            own = names[lo:lo + CALL_WORDS]
            lines = " " + "\n ".join(own) if after_space else "\n".join([x[1:] for x in own])
            part = lines.encode().decode("latin-1").translate(self.letters).split(self.line)
            ids = np.array(self.model.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=self.kind)
            ends, covered = np.cumsum(list(map(len, part))), np.cumsum(self.sizes[ids])
            stops = np.searchsorted(covered, ends) + 1
            if stops[-1] != len(ids) or not np.array_equal(covered[stops - 1], ends):
                raise ValueError("the ids don't cover the pre-tokens")
            self.words.add(pa.array(own, pa.string()), ids, np.diff(stops, prepend=0))

    def _pretokens(self, word: str) -> list[str]:
        if not word:
            return []
        if word.isalpha() or word[1:].isalpha() and word[0] == " ":
            return [word]
        if not _beyond.search(word):
            return _pretoken.findall(word)
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(word)  # the pieces by their places: the strings are stand-ins
        return [word[a:b] for _, (a, b) in found]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        even = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.zeros(0, self.kind)
            elif not self.by_word or len(t) > MAX_TEXT or _uneven(t) or (self.special and self.special.search(t)):
                out[i] = self.whole(t)
            else:
                even.append(i)
        if even:
            # every text as if it began a line: the id of that line end is left out below
            lines = pa.array(["\n" + texts[i].replace("\n", " \n") for i in even], pa.string())
            parts = pc.split_pattern(lines, " ")
            per_text, coded = np.diff(parts.offsets.to_numpy()), parts.flatten().dictionary_encode()
            before = len(self.words.starts)
            numbers = self._numbers(coded.dictionary)
            self.words.used[numbers[numbers < before]] = True
            which = numbers[coded.indices.to_numpy()]
            each = self.words.counts[which]
            flat = self.words.ids[_ranges(self.words.starts[which], each)]
            self.words.trim(CACHE_WORDS)
            stops = np.cumsum(each)[np.cumsum(per_text) - 1]
            for i, a, b in zip(even, np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist(), strict=True):
                out[i] = flat[a + 1:b]
        return out  # type: ignore[return-value]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; null is the empty text."""
        return self.encode_many([text or ""])[0]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0))) < 1 << 30 else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
