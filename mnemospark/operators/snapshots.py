"""The store as a log of immutable parts: chunks added, sources removed, feedback counted.

A change writes a part of its own size, and then a pointer that names the parts that count; readers merge them: a chunk counts unless its
source was removed after its part was written, and feedback is the sum of its parts.  A writer that dies before the pointer leaves the old
state, and a second writer is refused, not overwritten.  Readers hold the state that they loaded; ``prune`` removes what the last one
doesn't name.

Each part of chunks has its postings, so a recall reads those of its terms instead of all chunks' terms, and a Bloom filter of its ids,
sized by its rows, so new ids are told from stored ones without moving those.
When there are more than ``MOST_PARTS`` parts, the newest ones, as far back as they aren't much smaller than the next older one, become one part: what
is written again in all grows with the logarithm of the number of changes.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.terms import tokenized
from mnemospark.operators import bloom, index, pointers, store
from mnemospark.operators.scratch import written

#: Terms that another version of the tokenizer made are made anew when a part is loaded.
TOKENIZER_VERSION = 3
#: Chunks of a folder of a part's postings.
CHUNKS_PER_BUCKET = 20_000
#: Parts of chunks, or of removed sources, or of feedback, before they are merged.
MOST_PARTS = 32
#: Rows of small tables that are broadcast: removed sources, and ids that may be known.
FEW = 200_000

CHUNKS = (
    "id string, fnv string, seq long, source string, start_line int, end_line int, mtime timestamp, date string, when_ts timestamp, at timestamp, "
    "text string, terms array<string>, len int, embedding array<float>")
FEEDBACK = "terms array<string>, source string, count long, last_at timestamp"
NAME = "STATE"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Snapshot:
    chunks: DataFrame
    feedback: DataFrame
    updated_at: str | None = None
    state: dict = field(default_factory=lambda: {"number": 0, "chunks": [], "removed": [], "feedback": []})


def migrated(chunks: DataFrame) -> DataFrame:
    """``chunks`` with terms and len made anew from their texts."""
    made = tokenized(chunks.drop("terms", "len").withColumn("_raw", F.col("text")), "_raw", "terms").withColumn("len", F.size("terms"))
    return made.select(*chunks.columns, *[c for c in ("terms", "len") if c not in chunks.columns])


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _merged(spark: SparkSession, path: str, kind: str, schema: str, parts: list[dict], removed: list[dict]) -> DataFrame:
    """The rows of ``parts`` whose source wasn't removed after them."""
    frames = []
    for p in parts:
        own = spark.read.schema(schema).parquet(f"{path}/{p['folder']}/{kind}")
        if kind == "chunks" and p["tokenizer"] != TOKENIZER_VERSION:
            own = migrated(own)
        frames.append(own.select(*names(schema), F.lit(p["n"]).alias("_n")))
    rows = _union(frames, spark, f"{schema}, _n int")
    if removed and parts:
        gone = _union([spark.read.schema("source string").parquet(f"{path}/{r['folder']}/removed").withColumn("_m", F.lit(r["n"])) for r in removed], spark, "source string, _m int")
        gone = gone.groupBy(F.col("source").alias("_gone")).agg(F.max("_m").alias("_m"))
        gone = F.broadcast(gone) if sum(r["rows"] for r in removed) <= FEW else gone
        rows = rows.join(gone, (F.col("source") == F.col("_gone")) & (F.col("_n") < F.col("_m")), "left_anti")
    return rows.drop("_n")


def _loaded(spark: SparkSession, path: str, state: dict) -> Snapshot:
    chunks = _merged(spark, path, "chunks", CHUNKS, state["chunks"], state["removed"])
    counted = _merged(spark, path, "feedback", FEEDBACK, state["feedback"], state["removed"])
    counted = counted.groupBy("terms", "source").agg(F.sum("count").alias("count"), F.max("last_at").alias("last_at"))
    return Snapshot(chunks, counted.select(*names(FEEDBACK)), state.get("updated_at"), state)


def load(spark: SparkSession, path: str) -> Snapshot:
    """The current state; an empty one where there is none yet."""
    state = pointers.latest(spark, path, NAME)
    if state is None and pointers.exists(spark, f"{path}/CURRENT"):
        return _adopted(spark, path)
    return _loaded(spark, path, state or Snapshot(None, None).state)


def _adopted(spark: SparkSession, path: str) -> Snapshot:
    """The state of a store that an earlier version wrote as one whole folder, taken over as the first parts."""
    old = json.loads(spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0])
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/{old['folder']}/chunks")
    chunks = chunks if old["tokenizer"] == TOKENIZER_VERSION else migrated(chunks)
    return change(spark, path, _loaded(spark, path, Snapshot(None, None).state), added=chunks, feedback=spark.read.schema(FEEDBACK).parquet(f"{path}/{old['folder']}/feedback"))


def _write(rows: DataFrame, path: str, kind: str, n: int) -> dict:
    """A part of ``rows``, whole before anything names it."""
    spark, folder = rows.sparkSession, f"{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}/{kind}")
    part = {"n": n, "folder": folder, "rows": spark.read.parquet(f"{path}/{folder}/{kind}").count()}
    if kind == "chunks":
        part |= {"tokenizer": TOKENIZER_VERSION, "blocks": bloom.blocks_for(part["rows"]), "buckets": min(index.BUCKETS, 1 + part["rows"] // CHUNKS_PER_BUCKET)}
        own = spark.read.schema(CHUNKS).parquet(f"{path}/{folder}/chunks")
        bloom.build(own, "id", part["blocks"]).write.parquet(f"{path}/{folder}/ids")
        index.write_postings(own, f"{path}/{folder}/postings", part["rows"], "seq", part["buckets"])
    return part


def indexed(spark: SparkSession, path: str, now: Snapshot) -> index.Index | None:
    """The index (by seq) of all chunks of the parts, removed ones too; None if another tokenizer made some of it."""
    if any(p["tokenizer"] != TOKENIZER_VERSION for p in now.state["chunks"]):
        return None
    return index.Index(spark, [{"postings": f"{path}/{p['folder']}/postings", "buckets": p["buckets"]} for p in now.state["chunks"]])


def known_ids(spark: SparkSession, path: str, now: Snapshot, batch: DataFrame) -> DataFrame:
    """id: those of ``batch`` that the stored chunks have.  The stored ids stay where they are, unless a filter lets some of the batch through."""
    ids = batch.select("id").distinct()
    maybe = _union([
        bloom.may_hold(ids, "id", spark.read.schema("block long, bits binary").parquet(f"{path}/{p['folder']}/ids"), p["blocks"]) for p in now.state["chunks"]], spark, "id string")
    maybe = written(maybe.distinct(), "maybe")
    few = maybe.limit(FEW + 1).count() <= FEW
    return maybe.join(now.chunks.select("id"), "id", "left_semi") if not few else now.chunks.join(F.broadcast(maybe), "id").select("id").distinct()


def change(spark: SparkSession, path: str, now: Snapshot, added: DataFrame | None = None, removed: DataFrame | None = None, feedback: DataFrame | None = None,
           watched: dict[str, int] | None = None) -> Snapshot:
    """The state after ``removed`` sources (source) have gone, then chunks been ``added`` and ``feedback`` (terms, source, count, last_at) been counted in.

    ``watched`` (stream, batch) is kept with it.
    """
    state, n = {k: list(v) if isinstance(v, list) else v for k, v in now.state.items()}, now.state["number"] + 1
    if removed is not None:
        part = _write(removed.select("source").distinct(), path, "removed", n)
        state["removed"] += [part] if part["rows"] else []
    if added is not None:
        part = _write(added.select(*names(CHUNKS)), path, "chunks", n)
        state["chunks"] += [part] if part["rows"] else []
    if feedback is not None:
        part = _write(feedback.select(*names(FEEDBACK)), path, "feedback", n)
        state["feedback"] += [part] if part["rows"] else []
    if watched:
        state["watched"] = state.get("watched", {}) | watched
    out = _publish(spark, path, state, now.state["number"])
    if feedback is not None and (len(state["feedback"]) > MOST_PARTS or out.feedback.count() > store.MAX_FEEDBACK):
        # a table of MAX_FEEDBACK rows at most: written anew when entries go or parts are many
        best = out.feedback.orderBy(F.desc("last_at"), "source", "terms").limit(store.MAX_FEEDBACK)
        n = out.state["number"] + 1
        out = _publish(spark, path, out.state | {"feedback": [_write(best, path, "feedback", n)]}, out.state["number"])
    return compacted(spark, path, out)


def _publish(spark: SparkSession, path: str, state: dict, number: int) -> Snapshot:
    state = {**state, "updated_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    return _loaded(spark, path, {**state, "number": pointers.publish(spark, path, NAME, state, number)})


def compacted(spark: SparkSession, path: str, now: Snapshot, most: int | None = None) -> Snapshot:
    """``now`` with its newest parts merged, if it has more than ``most`` of a kind."""
    most = MOST_PARTS if most is None else most
    state, n = now.state, now.state["number"] + 1
    if max(len(state["chunks"]), len(state["removed"])) <= most:
        return now
    parts, rows, at = state["chunks"], 0, len(state["chunks"])
    while at and (rows == 0 or parts[at - 1]["rows"] <= 2 * rows or len(state["removed"]) > most):
        at -= 1
        rows += parts[at]["rows"]
    merged = _write(_merged(spark, path, "chunks", CHUNKS, parts[at:], state["removed"]), path, "chunks", n)
    out = {**state, "chunks": [*parts[:at], *([merged] if merged["rows"] else [])]}
    if not at:  # no older part is left that removals could count for; feedback takes them in as well
        out |= {"removed": [], "feedback": [_write(now.feedback, path, "feedback", n)] if state["feedback"] else []}
    return _publish(spark, path, out, state["number"])


def prune(spark: SparkSession, path: str) -> list[str]:
    """Remove the folders that the current state doesn't name, and older pointers; the folders' names."""
    state = pointers.latest(spark, path, NAME) or {}
    named = {p["folder"] for kind in ("chunks", "removed", "feedback") for p in state.get(kind, [])}
    fs, root = pointers.file_system(spark, path)
    old = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().partition("-")[0] in ("chunks", "removed", "feedback") and s.getPath().getName() not in named]
    for p in old:
        fs.delete(p, True)
    pointers.forget(spark, path, NAME, keep=1)
    return [p.getName() for p in old]
