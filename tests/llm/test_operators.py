import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import class_lm, common, decontam, exact_dedup, near_dedup, packing, pii, sharding, substring_dedup, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string"


def _texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [*enumerate(base)]
    rows += [(20, base[0]), (21, base[0] + " \n"), (22, base[1].replace(" ", "  ", 3)), (23, base[2] + " tail"), (24, base[3][:400] + base[4][:300])]
    rows += [(30, None), (31, ""), (32, "a b"), (33, "A B"), (5, base[5]), (None, "null id"), (40, "line of text that repeats " * 800), (41, "é" * 300)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in _texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup_against_brute_force(docs, empty):
    raws = [(i, (t or "").encode()) for i, t in _texts()]
    seen: dict[bytes, int] = {}
    for _, b in raws:
        for p in range(len(b) - 199):
            seen[b[p:p + 200]] = seen.get(b[p:p + 200], 0) + 1
    want = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    for hot in (20_000, 2):
        got = substring_dedup.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(3)
    texts = [b"p" * 32 + bytes(rng.choices(b"ab", k=rng.randint(0, 168))) for _ in range(400)]
    texts += texts[:40]
    order = substring_dedup.deep_shallow(list(range(len(texts))), texts)
    assert [texts[i] for i in order] == sorted(texts)


def test_decontamination_blocks_agree(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join((_texts()[3][1] or "").split()[5:30])), (2, "a b"), (3, None), (None, "null id")], "item_id long, text string")
    one = decontam.hits(docs, items).collect()
    many = decontam.find_items(docs, items, block_bytes=40).select("doc_id", "items").collect()
    assert {r.doc_id for r in one if r.contaminated} == {3, 24, 32, 33, None}
    assert {r.doc_id for r in many if r["items"]} == {3, 24, 32, 33, None}
    assert decontam.hits(empty, items).count() == 0 and not decontam.hits(docs, items.limit(0)).where("contaminated").count()


def test_near_duplicates_against_brute_force(docs, empty):
    rows = _texts()
    sets = [set(near_dedup.shingle_set(t, 4).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = lambda g: [r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None]
    want = sorted((str(r[0]), len(s), str(min(ids(g), default=None))) for r, s, g in zip(rows, sets, group, strict=True))
    got = near_dedup.near_duplicates(docs, width=4, small=3).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


def test_near_duplicates_of_one_template_against_brute_force(spark):
    """All pairs of 400 texts are 0.778 alike, but those of 2i and 2i + 1, which share twelve words more, 0.802; one size more is linked with none."""
    word = lambda *x: "w" + "x".join(map(str, x))
    texts = [[*(word(k) for k in range(700)), *(word("pair", i // 2, k) for k in range(12)), *(word("own", i, k) for k in range(88))] for i in range(400)]
    texts.append([word(k) for k in range(100)])
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows, 1).collect()}
    sets = [set(t) for t in texts]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked == {(i + 1, i) for i in range(0, 400, 2)}
    assert got == {i: i - i % 2 if i < 400 else i for i in range(401)}


def test_pii_base_and_redaction(spark, empty):
    rows = [(1, "mail a.b@c.de_f@g.hi or +1 (386) 555-3733, 4539578763621486, 1.2.3.4 and 999.1.1.1", "", "", 0, ""), (2, None, "", "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 1, 1)
    assert got[2].spans == "" and got[1].spans.startswith("email:5:13,email:13:20,")
    assert "[PHONE]" in {r.doc_id: r.text for r in pii.redact(docs).collect()}[1]
    assert pii.spans(empty).count() == 0


def _pii_by_hand(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's base spans, by a plain reading of its patterns."""

    def luhn(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = {}
    for kind, p in patterns.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


def test_pii_base_spans_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "1.2.3.4", "256.1.1.1", "0012.3.4.5", "4539578763621486", "4539 5787 6362 1486", "4539578763621487", "+1 (386) 555-3733", "+12", "++49 30 1234567",
            "é", "😀", " ", "\n", ".", "-", "1", "word", "@", "name[at]host[dot]org", "1.2.3.4.5.6.7.8", "a@b.c@d.e", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "a@b.cd " * 300 + "1.2.3.4 " * 200, "x" * 50_000 + "a@b.cd", texts[0], texts[0]]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in pii.spans(rows).collect():
        want = _pii_by_hand(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in want for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want.values()]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_pii_adds_obfuscated_spans(spark):
    """Half of the addresses and cards (of the phones one in twenty) are written so that the base patterns miss them; look-alikes
    without any evidence aren't added.  Precision and recall of what is added are 0.9 or more."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, planted, decoys = [], set(), set()

    def luhn_number() -> str:
        d = "4" + "".join(rng.choices("0123456789", k=14))
        s = sum(int(c) if i % 2 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return d + str(-s % 10)

    for i in range(600):
        text = f"{word()} {word()} "
        kind = rng.choice(["email", "ip", "phone", "card", "decoy"])
        hidden = rng.random() < (0.05 if kind == "phone" else 0.5)
        name, host = f"{word()}.{rng.randint(10, 99)}", word()
        ip = [str(rng.randint(0, 255)) for _ in range(4)]
        phone, d = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", luhn_number()
        made = {
            "email": f"{name} [at] {host} [dot] org" if hidden else f"{name}@{host}.org", "ip": "[dot]".join(ip) if hidden else ".".join(ip),
            "phone": phone if hidden else f"+1 {phone}", "card": "/".join(d[k:k + 4] for k in range(0, 16, 4)) if hidden else d,
            "decoy": f"{rng.randint(10, 99)} {rng.randint(100, 999)}.{rng.randint(1000, 9999)}"}[kind]
        if kind == "decoy":
            decoys.add((i, len(text)))
        elif hidden:
            planted.add((i, kind, len(text), len(text) + len(made)))
        rows.append((i, text + made + " " + word()))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.explode("added").alias("x")).select("doc_id", "x.*").collect()
    added = {(r.doc_id, pii.KINDS[r.kind], r.start, r.stop) for r in found}
    assert len(added & planted) >= 0.9 * len(planted) and len(added & planted) >= 0.9 * len(added)
    assert not {a[0] for a in added} & {i for i, _ in decoys}


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_dedup(docs).collect()
    keep = {(r.doc_id, r.keep_id) for r in got}
    assert {(0, 21), (20, 21), (21, 21), (30, 30), (31, 30), (1, 22)} <= keep
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 1 and left.count() == 20
    assert exact_dedup.exact_dedup(empty).count() == 0


def _ids(end: int) -> dict:
    from tokenizers import Tokenizer

    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {(i, t): np.array([*own.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in _texts()}


def test_token_files_round_trip(spark, docs, empty):
    want = sorted((str(i), len(x), zlib.crc32(x.tobytes())) for (i, _), x in _ids(2).items())
    back = token_files.read_tokens(spark, token_files.write_tokens(docs)).select("doc_id", "n_tokens", F.crc32("ids")).distinct().collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in back) == want
    assert token_files.read_tokens(spark, token_files.write_tokens(empty)).count() == 0


def test_packing_round_trip(docs, empty):
    pieces = packing.pack(docs, window=64).collect()
    place = sorted((r.sequence_id * 64 + r.offset, r.length) for r in pieces)
    assert place[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(place, place[1:], strict=False))
    assert sum(r.length for r in pieces) == sum(len(_ids(0)[i, t]) for i, t in _texts())
    assert packing.pack(empty).count() == 0


def test_language_model(docs, empty):
    """Counts and base scores against brute force."""
    got = class_lm.scores(docs).collect()
    assert len(got) == len(_texts()) and all(r.score < 0 and r.base_score < 0 for r in got)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]  # noqa: E731  None: the end
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count: dict = {}
    for i, t in _texts():
        if not held(i):
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(i), held(i), len(words(t)), sum(w in count for w in words(t)), n, round(float(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t))), 6)) for i, t in _texts())
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert class_lm.scores(empty).count() == 0


def test_exchange_gains_against_whole_likelihoods():
    """The class chosen for a word, its neighbours staying, is one of the best by the likelihood of the whole table."""
    rng = np.random.Generator(np.random.PCG64(2))
    classes, k = 4, 6
    text = (30 * rng.random(1_500) ** 2).astype(np.int64)
    text[100:140] = 7
    own = rng.integers(0, k, 30)
    table = lambda o: np.bincount(o[text[:-1]] * k + o[text[1:]], minlength=k * k).reshape(k, k).astype(float)
    packed, lengths = [], []
    for w in range(30):
        counts = np.zeros(2 * k + 1, np.int64)
        for a, b in zip(text, text[1:], strict=False):
            if a == b == w:
                counts[2 * k] += 1
            elif a == w:
                counts[own[b]] += 1
            elif b == w:
                counts[k + own[a]] += 1
        some = np.flatnonzero(counts)
        packed += list(counts[some] * (2 * k + 1) + some)
        lengths.append(len(some))
    got = class_lm.Gains(table(own), classes).best(own, np.array(packed), np.array(lengths))
    assert (got != own).sum() > 10
    for w in range(30):
        to = lambda c: class_lm.likelihood(table(np.where(np.arange(30) == w, c, own)))  # noqa: B023, E731
        best = max(to(c) for c in range(classes))
        assert got[w] < classes and abs(to(got[w]) - best) < 1e-6


def test_words_cut_in_arrow():
    """Words of odd texts against the regular expression, also of slices of a longer array; ids of long and alike words differ."""
    texts = [None, "", " ", "no", "  A\tb\x0b\x0cC\r\n", "\u00c9\x1c\u00c0 Z\u00a0z\u2003q\x85", "x" * 5_000 + " Y", "\x00 a", None, "ab\x1fc \U0001f600"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))] for t in texts]
    for lo, part in class_lm._slices(pa.array(["first", *texts]).slice(1)):
        words, lengths = class_lm.words_of(part)
        assert words.to_pylist() == [w for t in want[lo:lo + len(part)] for w in t] and lengths.tolist() == [len(t) for t in want[lo:lo + len(part)]]
    x, y = b"x" * 64, b"y" * 64
    words = [x, y, x + y, y + x, x + y + y + x, y + x + x + y, b"a", b"a\0", b"ab", b"ba"]
    ids = class_lm._ids(words)
    assert len(set(ids.tolist())) == len(words) and (ids < 0).all() and (class_lm._ids(pa.array([b"q", *words], pa.binary()).slice(1)) == ids).all()
    assert len(class_lm._ids([])) == 0


def test_alike_words_are_weighed_once(monkeypatch):
    """Words seen once between the same classes don't cost a weighing each, in one call or in several."""
    rng = np.random.Generator(np.random.PCG64(4))
    classes, k, m = 8, 10, 6_000
    gains = class_lm.Gains(rng.integers(1, 1_000, (k, k)).astype(float), classes)
    sides = np.stack([rng.integers(0, k, m), k + rng.integers(0, k, m)], axis=1)
    packed, lengths, own = (sides + 2 * k + 1).ravel(), np.full(m, 2), np.full(m, classes)
    want = np.concatenate([class_lm.Gains._part(gains, own[i:i + 1], packed[2 * i:2 * i + 2], lengths[:1]) for i in range(m)])
    weighed, part = [], class_lm.Gains._part
    monkeypatch.setattr(class_lm.Gains, "_part", lambda self, own, *rest: weighed.append(len(own)) or part(self, own, *rest))
    got = [gains.best(own[i:i + 1_000], packed[2 * i:2 * i + 2_000], lengths[:1_000]) for i in range(0, m, 1_000)]
    assert (np.concatenate(got) == want).all() and sum(weighed) <= k * k


def test_most_frequent_words(spark):
    """Over several partitions; ties go by word, and there may be fewer words than asked for."""
    count = {f"w{i}".encode(): 1 + 300 // (i + 1) for i in range(300)}
    counts = spark.createDataFrame(list(count.items()), "word binary, c long").repartition(12).cache()
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    for known in (1, 7, 150, 299, 300, 1_000):
        assert class_lm._top(counts, known) == want[:known]
    assert class_lm._top(counts.where("c < 0"), 5) == []
    counts.unpersist()


def test_words_are_looked_up_in_packed_rows(spark):
    """A row for each part and group, not for each word; every place is answered once, words never seen with count 0."""
    seen = [f"w{i}".encode() for i in range(500)]
    asked = {g: [f"w{i}".encode() for i in range(g, 700, 3)] for g in range(3)}
    own = {int(k): i % 5 for i, k in enumerate(class_lm._ids(seen))}
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(seen)], "word binary, c long")
    state = spark.createDataFrame(list(own.items()), "key long, own int")
    dealt = [class_lm._dealt(4, g, pa.array(w, pa.binary()), np.arange(len(w))) for g, w in asked.items()]
    assert sum(x.num_rows for x in dealt) <= 4 * 3
    look = spark.createDataFrame([tuple(r.values()) for x in dealt for r in x.to_pylist()], class_lm._LOOK)
    told: dict = {}
    for r in class_lm._answers(look.unionByName(class_lm._rare_words(counts, [], state, 4)), 5).collect():
        for at, word in np.frombuffer(bytes(r.told), np.int64).reshape(-1, 2).tolist():
            assert told.setdefault((r.sid, at), word) is word
    want = {w: (i + 1) * 7 + i % 5 for i, w in enumerate(seen)}
    assert told == {(g, at): want.get(w, 6) for g, words in asked.items() for at, w in enumerate(words)}


@pytest.mark.parametrize("rounds", [1, 2])
def test_every_word_has_a_class(docs, rounds):
    """Few known words, so that most are rare: class bigrams and scores against brute force, after classes of all words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [words(t) for i, t in _texts() if not held(i)]
    count = Counter(w for t in train for w in t)
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:40]
    rows = docs.where(F.pmod(common.doc_hash(), F.lit(7)) != 2)
    state, own, table, once, classes = class_lm.word_classes(rows, top, 20, 6, rounds)
    keys = {w: i for i, (w, _) in enumerate(top)}
    rare = [w for w in count if w not in keys]
    keys |= dict(zip(rare, class_lm._ids(rare).tolist(), strict=True))
    by_key = {r.key: r.own for r in state.collect()}
    of = {w: by_key[i] for w, i in keys.items()}
    assert len(rare) > 100 and all(of[w] == own[i] for i, (w, _) in enumerate(top)) and set(of.values()) <= set(range(classes))
    assert len({of[w] for w in rare}) > 1

    k, end = len(table), int(own[-1])
    path = lambda t: [end, *[of[w] for w in t], end]
    want, single = np.zeros((k, k)), np.zeros((3, k))
    for t in train:
        p = path(t)
        for a, b in zip(p, p[1:], strict=False):
            want[a, b] += 1
        for i, w in enumerate(t, 1):
            if count[w] == 1:
                single[0, p[i - 1]] += 1
                single[1, p[i + 1]] += 1
                single[2, p[i]] += 1
    assert (table == want).all() and (once == single).all()

    step = class_lm.transitions(table, once, classes, end, sum(count.values()) + len(train))
    assert np.allclose((10.0 ** step).sum(axis=1), 1)
    size = Counter()
    for w, c in count.items():
        size[of[w]] += c
    scores = []
    for i, t in _texts():
        p = [classes, *[of.get(w, classes + 1) for w in words(t)], classes]
        total = sum(step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(np.log10(count[w] / size[of[w]]) for w in words(t) if w in of)
        scores.append((str(i), held(i), round(float(total), 6)))
    got = class_lm.scores(docs, known=40, moved=20, classes=6, all_rounds=rounds).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == sorted(scores)


def test_rare_words_move_by_their_neighbours(spark):
    """Words past the moved and known ones: a text that keeps the order of two kinds of rare words is likelier than one that doesn't."""
    rng = random.Random(6)
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    texts = [" ".join(w for _ in range(20) for w in ("left", rng.choice(a), "right", rng.choice(b))) for _ in range(60)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, t) for i, t in zip((i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2), texts, strict=False)]
    rows += [(held[0], "left a1 right b1 left a2 right b2"), (held[1], "left b1 right a1 left b2 right a2")]
    got = class_lm.scores(spark.createDataFrame(rows, "doc_id long, text string"), known=10, moved=8, classes=6)
    score = {r.doc_id: r.score for r in got.where("held_out").collect()}
    assert score[held[0]] > score[held[1]] + 3


def test_min_cost_flow_moves_the_fewest():
    old, caps = {0: 10, 1: 50, 2: 0}, [20, 20, 20]
    blocks = sharding.transfers(old, caps)
    assert sum(b[2] - b[1] for b in blocks if b[0] != b[3]) == 30
    assert sum(b[2] - b[1] for b in blocks) == 60


def test_rewriting_leaves_other_shards(spark, tmp_path):
    """Shard 2 is untouched; 0 gives a row to 1; all of 3 goes to 1, so its folder goes."""
    rows = [(0, "a", 0, 0), (1, "b", 0, 1), (2, "c", 1, 1), (3, "d", 2, 2), (4, None, 2, 2), (5, "f", 3, 1), (5, "f", 3, 1)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows], "doc_id long, text string, shard int")
    path = str(tmp_path / "shards")
    docs.write.partitionBy("shard").parquet(path)
    before = {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()}
    assigned = spark.createDataFrame(
        [(i, len(t or "") + 8, zlib.crc32((t or "").encode()), s, j) for i, t, s, j in rows], "doc_id long, size long, text_crc32 long, old_shard int, shard int")
    assert sharding.rewrite(spark.read.parquet(path), assigned, path) == [0, 1, 3]
    left = sorted((r.shard, r.doc_id, r.text) for r in spark.read.parquet(path).where("text is not null").collect())
    assert left == sorted((j, i, t) for i, t, _, j in rows if t is not None) and spark.read.parquet(path).count() == 7
    assert {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()} == before and not (tmp_path / "shards" / "shard=3").exists()


def test_sharding(docs, empty):
    got = sharding.assign(docs, n_new=4).collect()
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(4)]
    assert len(got) == len(_texts()) and sum(sizes) == sum(len((t or "").encode()) + 8 for _, t in _texts())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(4))
    assert sharding.assign(empty).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.15, 1.0])
def test_block_max_index_is_exact(common):
    rng = np.random.Generator(np.random.PCG64(1))
    vectors = []
    for _ in range(300):
        t = np.unique((40 * rng.random(7) ** 2).astype(np.int64))
        w = rng.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.Index(vectors, np.zeros(300), list(range(300)), 40, block=16, common=common)
    full = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    place = {i: p for p, i in enumerate(index.order)}
    for i, (t, w) in enumerate(vectors[:40]):
        _, cosines = index.nearest(t, w, 10)
        want = np.sort(full @ full[i])[::-1]
        assert np.allclose(cosines, want[:10], atol=1e-6)
        places, cosines = index.nearest(t, w, 10, skip=place[i])
        assert place[i] not in places and np.allclose(cosines, np.sort(np.delete(full @ full[i], i))[::-1][:10], atol=1e-6)


def test_toxicity_scores_against_brute_force(spark):
    """Every score from its definition: idf over all documents, all cosines, votes, the isotonic fit."""
    rng = random.Random(4)
    words = ["w%d" % i for i in range(90)]
    rows = [(i, " ".join(rng.choices(words, weights=range(90, 0, -1), k=rng.randint(3, 40)) + ["Vile!"] * (i % 5 == 0 and rng.random() < 0.8))) for i in range(260)]
    rows += [(7, "another text of seven"), (300, None), (301, ""), (302, "unheard of")]
    marks = {i: int(i % 5 == 0) for i in range(200)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in marks.items()] + [(3, 0, 0), (None, 0, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.text_key): r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, k=5)).collect()}
    keys = {(r.doc_id, r.text): r.k for r in docs.select("doc_id", "text", toxicity.text_key(docs).alias("k")).collect()}

    train = {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        if i in marks and zlib.crc32(str(i).encode()) % 3 != 1 and i not in train:
            train[i] = toxicity.words_of(t)
    vocabulary = sorted({w for ws in train.values() for w in ws})
    df = {w: sum(w in toxicity.words_of(t) for _, t in rows) for w in vocabulary}
    n_toxic = sum(marks[i] for i in train)
    rate = (n_toxic + 0.5) / (len(train) + 1)

    def weight(w):
        a, b = (sum(w in ws for i, ws in train.items() if marks[i] == y) for y in (1, 0))
        g = 2 * (a * np.log(a / ((a + b) * rate)) + (b * np.log(b / ((a + b) * (1 - rate))) if b else 0)) if a > (a + b) * rate else 0.0
        return np.log((len(rows) + 1) / (df[w] + 1)) * (1 + g)

    weights = {w: weight(w) for w in vocabulary}

    def vector(ws):
        v = np.array([(1 + np.log(ws.count(w))) * weights[w] if w in ws else 0.0 for w in vocabulary])
        return v / np.linalg.norm(v) if v.any() else v

    ids = list(train)
    table, y = np.array([vector(ws) for ws in train.values()]), np.array([marks[i] for i in ids], float)

    def votes(cos):
        at = np.argsort(-cos, kind="stable")[:5]
        at = at[cos[at] > 1e-9]
        w = 1 / (1 - cos[at] + 0.05)
        return (w * y[at]).sum() / w.sum() if len(at) else 0.0, cos[at]

    own = []
    for p in range(len(ids)):
        cos = table @ table[p]
        cos[p] = -1
        own.append(votes(cos)[0])
    xs, ys = toxicity.isotonic(np.array(own), y)
    assert not any(not ws for ws in train.values())
    for i, t in rows:
        v = vector(toxicity.words_of(t))
        want = float(np.interp(votes(table @ v)[0], xs, ys)) if v.any() else 0.0
        assert abs(got[i, keys[i, t]] - want) < 1e-4, (i, t)


def test_toxicity(spark, empty):
    rows = [(i, f"word{i % 7} plain text " + ("awful " if i % 4 == 0 else ""), "", "", 0, "") for i in range(200)]
    docs = spark.createDataFrame([*rows, (500, None, "", "", 0, "")], SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(200)) and got[500] == 0
    assert toxicity.scored(empty, labels).count() == 0 and toxicity.scored(docs, labels.limit(0)).where("score > 0").count() == 0


def test_hot_groups_are_looked_up_by_name(spark):
    """With ``named`` the rows of ordinary groups pass through one join, not through a second one for the few hot groups; the values are the same."""
    rows = spark.range(3000).selectExpr("if(id < 1500, 7L, id) AS node", "id AS cid").unionByName(spark.createDataFrame([(None, -1)], "node long, cid long"))
    groups = rows.where("node % 2 = 1").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("cid").cast("string").cast("binary")).alias("sig"))
    some, all_ = (common.attach_groups(rows, groups, "node", "n", 3001, named=named) for named in (True, False))
    assert sorted(map(str, some.collect())) == sorted(map(str, all_.collect())) and some.where("n = 1500").count() == 1500
    assert some.schema == all_.schema
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert (joins(some), joins(all_)) == (1, 2)
    none = groups.where("n > 9999")
    assert common.attach_groups(rows, none, "node", "n", 3001, named=True).where("n is null").count() == 3001
