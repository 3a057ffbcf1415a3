"""The log of parts: what a change writes, crashes, writers, merging, and ids told apart by Bloom filters."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.memory import Memory
from mnemospark.operators import bloom, pointers, snapshots, store

NOW = dt.datetime(2026, 6, 10, tzinfo=dt.timezone.utc)


def _size(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def _chunks(spark, n, begin=0, source="s", words=40):
    rng = random.Random(begin)
    rows = [(f"id{i}", "f", i, f"{source}{i % 9}", 1, 1, NOW, None, NOW, NOW, " ".join(f"w{rng.randrange(10**9)}" for _ in range(words)), ["w"], 1, None) for i in range(begin, begin + n)]
    return spark.createDataFrame(rows, snapshots.CHUNKS)


def _ids(now):
    return sorted(r.id for r in now.chunks.select("id").collect())


def test_a_change_writes_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.change(spark, path, snapshots.load(spark, path), added=_chunks(spark, 20_000))
    memory, whole = Memory(spark, path, clock=lambda: NOW), _size(path)
    assert whole > 4_000_000
    for act in (lambda: memory.remember("one more note about zebras", "notes"), lambda: memory.reinforce("zebras note", "notes"), lambda: memory.forget("s8")):
        before = _size(path)
        act()
        assert 0 < _size(path) - before < 60_000
    assert memory.status()["chunks"] == 20_001 - len(range(8, 20_000, 9)) and Memory(spark, path).status()["chunks"] == memory.status()["chunks"]
    assert [(r.source, r["count"]) for r in memory.store.feedback.collect()] == [("notes", 1)]
    # a source that comes again after it was removed counts again, and its old rows don't
    now = snapshots.change(spark, path, memory.store, added=_chunks(spark, 9, 90_000))
    assert sorted(r.seq for r in now.chunks.where("source = 's8'").collect()) == [i for i in range(90_000, 90_009) if i % 9 == 8]


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    now = snapshots.change(spark, path, snapshots.load(spark, path), added=_chunks(spark, 5))
    with monkeypatch.context() as m:
        m.setattr(pointers, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            snapshots.change(spark, path, now, added=_chunks(spark, 5, 5), removed=spark.createDataFrame([("s1",)], "source string"))
    assert _ids(snapshots.load(spark, path)) == _ids(now) == [f"id{i}" for i in range(5)]
    assert len(snapshots.prune(spark, path)) == 2
    assert _ids(snapshots.change(spark, path, now, added=_chunks(spark, 1, 5))) == [f"id{i}" for i in range(6)]


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    one, two = Memory(spark, path, clock=lambda: NOW), Memory(spark, path, clock=lambda: NOW)
    one.remember("first", "a")
    with pytest.raises(RuntimeError, match="another writer"):
        two.remember("second", "b")
    reader = Memory(spark, path, clock=lambda: NOW)
    one.remember("third", "a")
    assert reader.status()["chunks"] == 1 and Memory(spark, path).status()["chunks"] == 2  # a reader keeps its state


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PARTS", 3)
    path = str(tmp_path / "store")
    now = snapshots.change(spark, path, snapshots.load(spark, path), added=_chunks(spark, 500))
    for i in range(6):
        gone = spark.createDataFrame([("t0",)], "source string") if i % 2 else None
        now = snapshots.change(spark, path, now, added=_chunks(spark, 9, 1000 + 9 * i, "t"), removed=gone)
        assert len(now.state["chunks"]) <= 4
    want = [f"id{i}" for i in range(500)] + [f"id{i}" for i in range(1000, 1054) if i % 9 or i >= 1045]
    assert _ids(now) == _ids(snapshots.load(spark, path)) == sorted(want)
    assert now.state["chunks"][0]["rows"] == 500  # the large part wasn't written again
    whole = snapshots.compacted(spark, path, now, most=0)
    assert (len(whole.state["chunks"]), _ids(whole)) == (2, sorted(want)) or len(whole.state["chunks"]) == 1 and _ids(whole) == sorted(want)
    snapshots.prune(spark, path)
    assert _ids(snapshots.load(spark, path)) == sorted(want)


def test_feedback_counts_and_its_cap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_FEEDBACK", 3)
    path, now = str(tmp_path / "store"), None
    now = snapshots.load(spark, path)
    for i, word in enumerate(["a", "b", "a", "c", "d", "b"]):
        events = spark.createDataFrame([([word], "s", 1, NOW + dt.timedelta(days=i))], snapshots.FEEDBACK)
        now = snapshots.change(spark, path, now, feedback=events)
    # b had left the three confirmed last when d came, and begins anew
    assert {r.terms[0]: r["count"] for r in snapshots.load(spark, path).feedback.collect()} == {"c": 1, "d": 1, "b": 1}


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_bloom_filters(spark, n):
    ids = spark.range(n).select(F.concat(F.lit("x"), "id").alias("id"))
    blocks = bloom.blocks_for(n)
    found = bloom.build(ids.unionByName(spark.createDataFrame([(None,)], "id string")), "id", blocks)
    assert bloom.may_hold(ids, "id", found, blocks).count() == n
    others = spark.range(20_000).select(F.concat(F.lit("y"), "id").alias("id"))
    assert bloom.may_hold(others, "id", found, blocks).count() <= 200 and bloom.may_hold(spark.createDataFrame([(None,)], "id string"), "id", found, blocks).count() == 0


def test_upsert_doesn_t_move_the_stored_ids(spark):
    stored = spark.range(3000).select(F.concat(F.lit("i"), "id").alias("id"), (F.col("id") % 10).cast("string").alias("source"), F.col("id").alias("seq"))
    batch = spark.createDataFrame([("i5", "new", 1), ("n1", "new", 3), ("n1", "new", 2), ("i3", "3", 9), (None, "new", 4)], "id string, source string, seq long")
    out = store.upsert(stored, batch, spark.createDataFrame([("3",)], "source string"))
    rows = {(r.id, r.source, r.seq) for r in out.collect()}
    assert {("n1", "new", 2), ("i3", "3", 9), ("i5", "5", 5), (None, "new", 4)} <= rows and len(rows) == 2700 + 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the rows that are exchanged by hash are those of the batch and the few found ids; the stored ones (a range here) are only filtered and joined in place
    assert plan.count("Range (0, 3000") >= 1
    for part in plan.split("Exchange hashpartitioning")[1:]:
        assert "Range (0, 3000" not in part.split("Exchange")[0] or "BroadcastHashJoin" in part.split("Range (0, 3000")[0]


def test_recall_from_the_parts_postings_is_that_from_the_terms(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    memory = Memory(spark, path, clock=lambda: NOW)
    for i in range(6):
        memory.remember(f"zebra note {i} about pricing plan " + "zebra " * i, f"s{i % 3}", f"2026-0{i + 1}-01")
    memory.forget("s1")
    memory.remember("another zebra pricing plan", "s1")
    memory.reinforce("zebra plan", "s0")
    asked = spark.createDataFrame([(1, "zebra pricing"), (2, "note about plans"), (3, "nothing at all here")], "qid int, query string")
    options = ({}, {"since": "2026-03-01"}, {"until": "2026-05-15", "limit": 2})
    rows = lambda: [[tuple(r) for r in memory.recall_batch(asked, **o).collect()] for o in options]
    stored = rows()
    assert len(stored[0]) >= 8 and not any("s1" in r and "note 1" in str(r) for r in stored[0])
    monkeypatch.setattr(snapshots, "indexed", lambda *_: None)
    assert rows() == stored


def test_a_store_of_the_former_form_is_taken_over(spark, tmp_path):
    path = tmp_path / "store"
    _chunks(spark, 7).withColumn("terms", F.array(F.lit("old"))).write.parquet(f"{path}/snapshot-1/chunks")
    spark.createDataFrame([(["w"], "s1", 3, NOW)], snapshots.FEEDBACK).write.parquet(f"{path}/snapshot-1/feedback")
    (path / "CURRENT").write_text('{"folder": "snapshot-1", "updated_at": "2026-01-01", "tokenizer": 2}')
    now = snapshots.load(spark, str(path))
    assert _ids(now) == _ids(snapshots.load(spark, str(path))) == [f"id{i}" for i in range(7)] and now.chunks.where("array_contains(terms, 'old')").count() == 0
    assert [(r.source, r["count"]) for r in now.feedback.collect()] == [("s1", 3)]
