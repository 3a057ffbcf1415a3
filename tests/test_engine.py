import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import terms
from mnemospark.functions import text as T
from mnemospark.functions import time as D
from mnemospark.operators import chunking, ranking, store
from mnemospark.plans import queries


@pytest.mark.parametrize(("word", "stem"), [
    ("queries", "queri"), ("query", "queri"), ("caches", "cach"), ("classes", "class"), ("processes", "process"), ("shipped", "ship"),
    ("running", "run"), ("roll", "roll"), ("making", "mak"), ("make", "mak"), ("postgres", "postgresql"), ("auth", "authentic"),
    ("nation", "n"), ("sing", "s"), ("used", "us"), ("need", "ne"), ("ment", ""),
])
def test_stem(spark, word, stem):
    assert T.stemmed(spark.createDataFrame([(word,)], "w string"), "w", "s").first().s == stem == terms.stem(word)


def test_tokenize_keeps_order_and_drops_other_scripts(spark):
    df = spark.createDataFrame([("Don't use café",), ("Привет",)], "t string").select(T.tokenize(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [["don't", "use", "caf"], []]


def test_both_tokenizers_agree(spark):
    rng = random.Random(1)
    parts = [*T.SUFFIXES, *T.LEMMAS, *T.ALIASES, *T.STOPWORDS, "ss", "ies", "sses", "ly", "ee", "y", "ay", "bb", "ll", "zz", "x", "'", "-", "_", "é", "Ü", "9", " ", ". "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    for stemming in (True, False):
        got = {r.i: r.terms for r in terms.tokenized(df, "t", stemming=stemming).collect()}
        assert got == {r.i: r.x or [] for r in df.select("i", T.tokenize(F.col("t"), stemming).alias("x")).collect()}


@pytest.mark.parametrize(("text", "date"), [
    ("2026-13-01 … May 3, 2026", "2026-05-03"), ("2026-13-01 … 2026-05-03", None), ("Mayhem 3 2026", None), ("Sept. 9, 2026", "2026-09-09"),
    ("2026-02-31", "2026-02-31"), ("é2026-05-20", "2026-05-20"), ("none", None),
])
def test_extract_date(spark, text, date):
    assert spark.createDataFrame([(text,)], "t string").select(D.extract_date(F.col("t")).alias("d")).first().d == date


def test_parse_when():
    now = dt.datetime(2026, 6, 10, tzinfo=dt.timezone.utc)
    assert [(now - D.parse_when(v, now)).days for v in ("today", "7d", "2 w", "1m", "1y")] == [0, 7, 14, 30, 365]
    assert D.parse_when("", now) is None
    for bad in ("soon", "Today", " 7d", "7 D"):
        with pytest.raises(ValueError):
            D.parse_when(bad, now)


def test_html(spark):
    df = spark.createDataFrame([("a&amp;lt;b",), ('x<br class="q">y',), ("&#65;<p>b</p>c",)], "h string")
    assert [r.x for r in df.select(T.html_to_text(F.col("h")).alias("x")).collect()] == ["a&lt;b", "x y", "A b\nc"]


def test_fold_lines():
    head = lambda n: list(chunking.fold_lines("x" * (n - 1) + "\n# h"))
    assert len(head(199)) == 1 and len(head(200)) == 2
    assert len(list(chunking.fold_lines("y" * 5000))) == 1
    spans = [(a, b) for a, b, _ in chunking.fold_lines("\n".join(["z" * 100] * 40))]
    assert spans == sorted(spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_upsert_is_idempotent(spark):
    rows = spark.createDataFrame([("a", "s1", 0), ("b", "s2", 1)], "id string, source string, seq int")
    once = store.upsert(rows, rows.where("source = 's1'"), rows.where("source = 's1'"))
    assert {r.id for r in once.collect()} == {"a", "b"} and once.count() == 2
    assert {r.id for r in store.forget(rows, "s1").collect()} == {"b"}


def test_feedback_takes_whole_turns(spark, tmp_path):
    """Turns that differ only after 40 characters, or hold only stop words before, are counted apart."""
    filler = "the and of to in is it the and of to in is it "
    turns = [(1, 1, "user", filler + "alpha"), (1, 2, "user", filler + "beta"), (1, 3, "user", filler + "alpha"), (2, 1, "assistant", "gamma"), (3, 1, "user", "delta"), (4, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {("alpha", "src1", 2, 3), ("beta", "src1", 1, 2), ("delta", "src3", 1, 1)}
    stems = {w: T.stemmed(spark.createDataFrame([(w,)], "w string"), "w", "s").first().s for w in ("alpha", "beta", "delta")}
    want = {(stems[w], *rest) for w, *rest in want}
    assert {tuple(r) for r in queries.feedback_upsert(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in queries.feedback_cap(spark, str(tmp_path)).collect()} == want


def _snippet_by_hand(text, terms, width=240):
    lower, hits = text.lower(), []
    for t in filter(None, terms):
        at = lower.find(t)
        while at >= 0:
            hits.append(at)
            at = lower.find(t, at + len(t))
    if not hits:
        return text[:width].strip() + ("…" if len(text) > width else "")
    hits.sort()
    begin = max(0, max(hits, key=lambda h: (sum(h <= x < h + width for x in hits), -h)) - width // 6)
    end = min(len(text), begin + width)
    return ("…" if begin else "") + text[begin:end].strip() + ("…" if end < len(text) else "")


def test_snippet_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gam", "a.b", "x(y", "filler", "\n", "  "]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 120))), rng.sample(["alpha", "gam", "a.b", "x(y", "", "none"], rng.randint(0, 4))) for _ in range(200)]
    got = spark.createDataFrame(rows, "t string, w array<string>").select(T.snippet(F.col("t"), F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == [_snippet_by_hand(*r) for r in rows]


def test_fnv1a_takes_utf16_units(spark):
    def by_hand(text):
        h = 2166136261
        raw = text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i:i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "note:1:é", "日本", "😀 x"]
    assert [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fnv1a(F.col("t")).alias("x")).collect()] == list(map(by_hand, texts))


@pytest.mark.parametrize(("limit", "want"), [(None, 8), (0, 8), (-3, 8), (0.5, 1), (3.9, 3), (float("nan"), 8), (float("inf"), 8), ("4", 8)])
def test_limit(limit, want):
    assert ranking.limit_of(limit) == want


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)] if i % 9 else [0.0] * 4) for i in range(120)] + [(200, [1.0]), (201, None)]
    rows = spark.createDataFrame(vectors, "id long, embedding array<double>").repartition(3)
    one = sorted(map(tuple, ranking.nearest(rows.where("id % 10 = 0"), rows, 3, "id").collect()))
    monkeypatch.setattr(ranking, "VECTORS", 5)
    assert sorted(map(tuple, ranking.nearest(rows.where("id % 10 = 0"), rows, 3, "id").collect())) == one and len(one) == 13 * 3
    assert {(q, k) for q, k, _, r in one if r == 1 and q % 9 and q < 200} == {(q, q) for q in range(0, 120, 10) if q % 9}
    assert ranking.nearest(rows.limit(0), rows, 3, "id").count() == 0


NOTES = {
    "stack": "# Stack\n\n2026-01-20 - we picked postgres over mongo as the database.\n", "pricing-old": "# Plans\n\n2026-02-01 - pricing is one flat fee.\n",
    "pricing-new": "# Plans\n\n2026-06-01 - pricing is a free tier with credits.\n", "outage": "# Incident\n\n2026-05-10 - webhook retries caused the outage; we shipped a fix.\n",
}


@pytest.mark.parametrize(("asked", "since", "want"), [
    ("which database did we choose, postgres?", None, ["stack"]), ("pricing fee", None, ["pricing-old", "pricing-new"]), ("pricing", None, ["pricing-new", "pricing-old"]),
    ("what caused the webhook outage", None, ["outage"]), ("pricing", "2026-05-01", ["pricing-new"]), ("zebra", None, [])])
def test_recall_of_notes(spark, asked, since, want):
    now = dt.datetime(2026, 6, 10)
    rows = spark.createDataFrame([(k, t, now) for k, t in NOTES.items()], "source string, text string, mtime timestamp")
    recs = chunking.records(chunking.chunk_files(rows)).withColumns({"at": F.coalesce("when_ts", "mtime"), "seq": F.xxhash64("source")})
    found = ranking.recall(recs, spark.createDataFrame([(1, asked)], "qid int, query string"), F.lit(now), since=since and F.lit(since).cast("timestamp"), key="source")
    assert [r.source for r in found.orderBy("rank").collect()] == want


def test_bonus_of_all_pairs_of_blocks(spark, monkeypatch):
    """Every pair of a query and an entry counts, whatever the blocks, and no row is made for a pair that shares a common term only."""
    monkeypatch.setattr(ranking, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ranking, "BLOCK_ENTRIES", 11)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    asked = {q: rng.choices(words, k=rng.randint(1, 12)) for q in range(30)}
    fed = [(sorted({"all", *rng.sample(words, rng.randint(0, 6))}), rng.choice(["a", "b", None]), rng.randint(1, 300)) for _ in range(80)]
    terms = spark.createDataFrame([(q, i, t) for q, x in asked.items() for i, t in enumerate([*x, "all"])], "qid long, qpos int, term string")
    want: dict[tuple, float] = {}
    for q, x in asked.items():
        for t, s, c in fed:
            o = len({*x, "all"} & set(t)) / len(t)
            if o >= 0.5:
                want[q, s] = max(want.get((q, s), 0), o * min(0.3, 0.1 + 0.05 * math.log1p(c)))
    made = ranking.bonus(terms, spark.createDataFrame([*fed, ([], "a", 5)], "terms array<string>, source string, count long"))
    assert {(r.qid, r.source): round(r.bonus, 9) for r in made.collect()} == {k: round(v, 9) for k, v in want.items()}
    plan = made._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan
    assert ranking.bonus(terms.limit(0), spark.createDataFrame(fed, "terms array<string>, source string, count long")).count() == 0
