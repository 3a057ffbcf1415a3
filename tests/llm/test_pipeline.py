"""Every stage of the corpus pipeline against a plain version of it, on the same input."""

import random
import re

import pytest

import corpus_pipeline
from mnemospark.llm import near_dedup, packing, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit boolean, _hit string, _bm_row long, __ms_tk string, shard int"


def _rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    texts = {i: t for i, t in enumerate(base)}
    for i in range(0, 60, 5):
        texts[i] += " vile vile idiot"
    texts |= {100: base[1], 101: base[1] + " \n", 102: base[2] + " more", 103: base[2].replace(" ", "  "), 104: "prefix words then " + " ".join(base[59].split()[10:30]), 105: None, 106: "", 107: "x" * 5000}
    rows = [(i, t) for i, t in texts.items()] + [(3, base[3]), (3, base[3]), (None, "no id at all")]
    return [(i, t, "en", "s", 0, True, f"kept{n}", n, "clash", 7) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join((rows[59][1] or "").split()[10:30])
    spark.createDataFrame([(1, item), (2, "not anywhere in the corpus"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def _plain_exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(_normal(r[1]), []).append(r)
    return [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]


def _plain_near(rows):
    sets = [frozenset(near_dedup.shingle_set(r[1], 5).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    return list(best.values())


def _plain_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    hit = lambda w: any(tuple(w[i:i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))
    return [r for r in rows if not hit(words(r[1]))]


def test_stages_against_plain_versions(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    start, items = held(docs), [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    plain = {
        "toxicity": lambda rows: [r for r in rows if model.score(r[1])[0] < toxicity.THRESHOLD], "exact_dedup": _plain_exact, "near_dedup": _plain_near,
        "decontamination": lambda rows: _plain_clean(rows, items)}
    counts = [len(start)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows, want = held(out), sorted(plain[name](held(docs)), key=str)
        # of rows equal in doc_id and text any one may stay
        assert sorted(((r[0], r[1]) for r in rows), key=str) == sorted(((r[0], r[1]) for r in want), key=str), name
        assert set(rows) <= set(start)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(len(rows))
    assert all(a > b for a, b in zip(counts, counts[1:], strict=False))
    left = {r[0] for r in held(docs)}
    assert not {104, 100, 1, 2, 103} & left and {101, 102, 4} <= left

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    enc = tokens.Encoder(open(tokens.default_tokenizer(), encoding="utf-8").read())
    texts = {r[0]: r[1] for r in held(docs)}
    ids = {i: [*enc.encode(t).tolist(), packing.END_ID] for i, t in texts.items()}
    at = sorted((r.sequence_id * packing.WINDOW + r.offset, r.length) for r in pieces)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    found: dict = {}
    for r in sorted(pieces, key=lambda r: r.start):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.start == len(found.get(r.doc_id, []))
        found.setdefault(r.doc_id, []).extend(memoryview(bytes(r.ids)).cast("H").tolist())
    assert found == ids


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
