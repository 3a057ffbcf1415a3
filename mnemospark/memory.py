"""The facade: ingest files, remember texts, recall, reinforce, forget, status, answers, and a live watch."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions import time as D
from mnemospark.operators import chunking, ranking, snapshots, store
from mnemospark.operators.scratch import written
from mnemospark.sources import files

#: Characters of a text that go to an embedder.
MAX_EMBED_CHARS = 4000

Embedder = Callable[[str], list[float]]
Chat = Callable[[str, str], str]

SYSTEM = "Answer from the given passages alone and cite them as [n]. If they don't hold the answer, say so. Be brief."


def embedded(rows: DataFrame, embed: Embedder, text: str = "text") -> DataFrame:
    """``rows`` with ``embedding``; a text that the embedder fails on has null, and if it fails on every one, the run fails."""
    kept = [c for c in rows.columns if c != "embedding"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", embedding array<float>, embed_error string"
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, errors = [], []
            for t in batch.column(at).to_pylist():
                vector, error = None, None
                try:
                    vector = embed((t or "")[:MAX_EMBED_CHARS])
                except Exception as e:  # the chunk stays without a vector
                    error = str(e) or type(e).__name__
                vectors.append(vector)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*kept, "embedding", "embed_error"])

    made = written(rows.select(*kept).mapInArrow(run, schema), "embedded")
    state = made.agg(F.count(F.lit(1)).alias("n"), F.count("embed_error").alias("failed"), F.min("embed_error").alias("error")).first()
    if state.n and state.failed == state.n:
        raise RuntimeError(f"nothing could be embedded: {state.error}")
    return made.drop("embed_error")


class Memory:
    """A store of chunks below ``path``; every change adds a part of its own size."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedder | None = None, chat: Chat | None = None, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.path, self.embed, self.chat = spark, path.rstrip("/"), embed, chat
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.store = snapshots.load(spark, self.path)

    def _change(self, **parts) -> None:
        self.store = snapshots.change(self.spark, self.path, self.store, **parts)

    def _now(self) -> Column:
        return F.lit(self.clock())

    def _added(self, recs: DataFrame, replaced: DataFrame | None) -> int:
        """Put records (with an order column ``chunk_no``) into the store; how many are new."""
        first = (self.store.chunks.agg(F.max("seq")).first()[0] or 0) + 1
        if "embedding" not in recs.columns:
            recs = recs.withColumn("embedding", F.lit(None).cast("array<float>"))
        ordered = recs.repartitionByRange("source", "chunk_no").sortWithinPartitions("source", "chunk_no")
        batch = written(ordered.withColumn("seq", F.lit(first) + F.monotonically_increasing_id()).withColumn("at", F.coalesce("when_ts", "mtime")), "batch")
        before = self.store
        known = snapshots.known_ids(self.spark, self.path, before, batch)
        if replaced is not None:  # ids of sources that are replaced may come again
            again = before.chunks.join(F.broadcast(written(known, "known")), "id").select("id", "source")  # ids of the batch alone
            known = again.join(replaced.select("source").distinct(), "source", "left_anti").select("id").distinct()
        fresh = written(store.first_of_each(batch.join(known, "id", "left_anti"), "id", "seq").select(*before.chunks.columns), "fresh")
        self._change(added=fresh, removed=replaced)
        return fresh.count()

    def ingest(self, paths: Sequence[str], force: bool = False) -> dict:
        """Read the changed files below ``paths``; counts of files, and the ones that failed.  Files that are gone stay in the store."""
        return self._read(paths, written(files.walk(self.spark, paths), "listing"), force)

    def ingest_files(self, paths: Sequence[str], listing: DataFrame, gone: DataFrame | None = None, watched: dict[str, int] | None = None) -> dict:
        """Read those of the listed files (source, mtime) below ``paths`` that the store doesn't hold as they are, and remove the sources that are ``gone``.

        ``watched`` names the batch of a stream that this is; a store that has it isn't given it again.
        """
        out = self._read(paths, listing, False)
        self._change(removed=gone, watched=watched)
        return out

    def _read(self, paths: Sequence[str], listing: DataFrame, force: bool) -> dict:
        total = listing.count()
        todo = listing if force else store.changed(listing, self.store.chunks)
        todo = written(todo.select("source"), "changed")
        n_changed = todo.count()
        texts = written(files.extracted(files.contents(self.spark, paths, todo)), "texts")
        failed = [{"file": r.source, "reason": r.error} for r in texts.where("error is not null").select("source", "error").toLocalIterator()]
        good = texts.where("error is null")
        added = 0
        if n_changed > len(failed):
            recs = chunking.records(chunking.chunk_files(good))
            if self.embed is not None:
                recs = embedded(recs, self.embed)
            added = self._added(recs, good)
        return {"files": total, "changed": n_changed - len(failed), "unchanged": total - n_changed, "chunks": added, "embedded": self.embed is not None and total > 0, "failed": failed}

    def remember(self, text: str, source: str = "api", date: str | None = None) -> dict:
        """Store one text as one chunk; ``added`` is 0 if its source has a chunk that begins the same."""
        made = self.spark.createDataFrame([(source, text, date)], "source string, text string, given string")
        when = F.coalesce(D.date_to_time(F.col("given")), self._now())
        made = made.select(
            "source", "text", F.lit(0).alias("chunk_no"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), self._now().alias("mtime"),
            F.coalesce("given", D.extract_date(F.col("text"))).alias("date"), when.alias("when_ts"))
        added = self._added(chunking.records(made), None)
        return {"added": added, "chunks": self.store.chunks.count()}

    def recall_batch(self, queries: DataFrame, limit: float | None = None, since: str | None = None, until: str | None = None,
                     weights: dict[str, float] | None = None, half_life_days: float = D.HALF_LIFE_DAYS) -> DataFrame:
        """The results for queries (qid, query; ``embedding`` too, for the semantic part)."""
        now = self.clock()
        lo, hi = (D.parse_when(x, now) for x in (since, until))
        recs = self.store.chunks
        ends = {"since": None if lo is None else F.lit(lo), "until": None if hi is None else F.lit(hi)}
        semantic = None
        if "embedding" in queries.columns:
            asked = written(queries.select("qid", F.col("embedding").alias("asked")).where("asked is not null"), "asked")
            if asked.limit(ranking.VECTORS + 1).count() > ranking.VECTORS:
                raise ValueError(f"at most {ranking.VECTORS} queries with embeddings at once")
            near = ranking.within(recs, **ends).where("embedding is not null").select("seq", "embedding").join(F.broadcast(asked))  # at most VECTORS rows
            semantic = near.select("qid", "seq", ranking.cosine(F.col("embedding"), F.col("asked")).alias("cosine")).where("cosine > 0")
            if semantic.isEmpty():
                semantic = None
        plain = queries.select("qid", "query")
        top = ranking.recall(recs, plain, F.lit(now), ranking.limit_of(limit), **ends, semantic=semantic, feedback=self.store.feedback, key="seq", weights=weights, half_life_days=half_life_days,
                             index=snapshots.indexed(self.spark, self.path, self.store))
        return ranking.results(written(top, "top"), recs, plain, "seq").orderBy("qid", "rank")

    def recall(self, query: str, limit: float | None = None, **options) -> list[dict]:
        """The best chunks for one query, as dictionaries."""
        vector = self.embed(query[:MAX_EMBED_CHARS]) if self.embed is not None else None
        rows = [(0, query, vector)] if vector is not None else [(0, query)]
        asked = self.spark.createDataFrame(rows, "qid int, query string" + (", embedding array<float>" if vector is not None else ""))
        return [{k: v for k, v in r.asDict().items() if k not in ("qid", "seq", "rank")} for r in self.recall_batch(asked, limit, **options).collect()]

    def reinforce(self, query: str, source: str) -> list[str]:
        """Count ``query`` as answered by the sources that contain ``source``; their names."""
        asked = self.spark.createDataFrame([(0, query)], "qid int, query string").select(T.tokenize(F.col("query")).alias("terms"))
        events = self.store.chunks.where(F.col("source").contains(source)).select("source").distinct().crossJoin(F.broadcast(asked))  # one row
        events = written(events.where(F.size("terms") > 0).withColumn("at", self._now()), "events")
        found = sorted(r.source for r in events.select("source").collect())
        if found:
            self._change(feedback=store.events_counted(events))
        return found

    def forget(self, needle: str) -> int:
        """Remove the chunks and the feedback of all sources that contain ``needle``; how many chunks went."""
        before = self.store.chunks.count()
        sources = self.store.chunks.select("source").unionByName(self.store.feedback.select("source"))
        self._change(removed=sources.where(F.col("source").contains(needle)))
        return before - self.store.chunks.count()

    def status(self) -> dict:
        r = store.stats(self.store.chunks).first()
        return {"chunks": r.chunks, "sources": r.sources, "with_embedding": r.with_embedding, "updated_at": self.store.updated_at}

    def passages(self, query: str, limit: float | None = 6, **options) -> str:
        """The results as numbered passages."""
        asked = self.spark.createDataFrame([(0, query)], "qid int, query string")
        row = T.format_passages(self.recall_batch(asked, limit, **options)).first()
        return row.passages if row else f'No memories matched "{query}".'

    def ask(self, query: str, limit: float | None = 6, **options) -> str:
        """An answer by the chat model from the results, or the passages themselves where there is no model or it fails."""
        found = self.passages(query, limit, **options)
        if self.chat is None:
            return found
        try:
            return self.chat(SYSTEM, f"Question: {query}\n\nPassages:\n{found}").strip() or found
        except Exception:  # the passages are the answer then
            return found

    def to_json(self, query: str, **options) -> str:
        return json.dumps(self.recall(query, **options), default=str, ensure_ascii=False)

    def watch(self, paths: Sequence[str], interval: str = "2 seconds", on_error: Callable[[Exception], None] = print, **options):
        """Ingest ``paths`` now and whenever their files change; returns the streaming query, whose ``stop`` ends it."""
        from mnemospark.streaming.watch import watch

        return watch(self, paths, interval, on_error, **options)


# The error codes of JSON-RPC 2.0.
INVALID_REQUEST, NO_METHOD, BAD_PARAMS, FAILED, NO_JSON = -32600, -32601, -32602, -32603, -32700

TOOLS = {
    "recall": (("query",), ("limit", "since", "until")), "remember": (("text",), ("source", "date")),
    "reinforce": (("query", "source"), ()), "status": ((), ())}


def tool(memory: Memory, name: str, given: dict) -> str:
    """The text that a tool call answers with."""
    needed, more = TOOLS[name]
    if missing := [k for k in needed if not given.get(k)]:
        raise ValueError(f"{' and '.join(missing)} required")
    options = {k: given[k] for k in (*needed, *more) if given.get(k) is not None}
    if name == "recall":
        return memory.passages(options.pop("query"), options.pop("limit", 6), **options)
    if name == "remember":
        done = memory.remember(**{"source": "agent", **options})
        return f"Remembered. {done['chunks']} memories stored." if done["added"] else "Nothing stored: the source has a memory that begins the same, or the text has no words."
    if name == "reinforce":
        found = memory.reinforce(**options)
        return f"Reinforced: {', '.join(found)}" if found else f'No stored source matches "{options["source"]}": nothing reinforced.'
    s = memory.status()
    return f"{s['chunks']} chunks across {s['sources']} sources ({s['with_embedding']} with embeddings)."


def respond(memory: Memory, line: str) -> dict | None:
    """The JSON-RPC response to one request line: initialize, ping, tools/list, tools/call; None for a notification."""

    def failed(id_, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    try:
        request = json.loads(line)
    except ValueError:
        return failed(None, NO_JSON, "parse error")
    if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
        return failed(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "invalid request")
    if "id" not in request:
        return None
    id_, method, params = request["id"], request["method"], request.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "mnemospark", "version": "2"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {} for k in (*need, *more)}, "required": [*need]}} for n, (need, more) in TOOLS.items()]}
    elif method == "tools/call":
        if params.get("name") not in TOOLS:
            return failed(id_, BAD_PARAMS, f"unknown tool: {params.get('name')}")
        try:
            result = {"content": [{"type": "text", "text": tool(memory, params["name"], params.get("arguments") or {})}]}
        except ValueError as e:
            result = {"content": [{"type": "text", "text": str(e)}], "isError": True}
        except Exception as e:
            return failed(id_, FAILED, str(e))
    else:
        return failed(id_, NO_METHOD, f"unknown method: {method}")
    return {"jsonrpc": "2.0", "id": id_, "result": result}
