"""A live watch: a stream of files that were added, changed or removed, each told once it has been quiet for a while.

Spark's own file stream gives a path once, so a rewritten file would be missed.  This source's offsets are times: a batch lists the folders
as they are, in tasks on the executors, one for each root and each folder directly below one; the driver sees the names of
those folders alone.  What is known of each file is state keyed by its name: the version seen last and since when, and the version told
last.  A file is told when a version has stood for ``quiet_ms``, so a burst of writes is one change; one that the listings lack
runs into its timer, and is told as removed.  The state lives in the query's checkpoint: a restarted watch goes on from it.

Ingesting is by batch: the store's pointer names the last batch of each watch, and a batch that is run again is dropped.  A batch that
fails is reported, and the whole of the folders is compared with the store in the next one.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.operators.scratch import written
from mnemospark.sources import files

QUIET_MS = 600
LISTED = "source string, mtime long, length long, seen long"
KNOWN = "mtime long, length long, since long, told_mtime long, told_length long"
TOLD = "source string, mtime timestamp, length long, kind string"

_kinds = re.compile(rf"(?i)\.(?:{'|'.join((*files.TEXT, *files.HTML, *files.PACKED))})$")


def _system(path: str):
    """Arrow's file system of ``path``, the path there, and what Spark writes before it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/"), "file:"
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/"), path[:path.index(root)]


def taken(path: str, root: str) -> bool:
    """Whether a walk of ``root`` takes the file: by its extension, and by the root's own name and the folders below it."""
    name, *below = reversed(path[len(root.rpartition("/")[0]) + 1:].split("/"))
    hidden = any(p.startswith((".", "_")) for p in (name, *below[:-1]))
    return bool(_kinds.search(name)) and not hidden and not set(files.SKIPPED).intersection(below)


@dataclass
class Part(InputPartition):
    root: str
    folder: str
    deep: bool


class Listing(DataSourceStreamReader):
    def __init__(self, paths: Sequence[str]):
        self.paths = paths

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        from pyarrow import fs

        out = []
        for path in self.paths:
            system, root, _ = _system(path)
            out.append(Part(path, root, False))
            if system.get_file_info(root).type == fs.FileType.Directory:
                out += [Part(path, f.path, True) for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        system, root, prefix = _system(partition.root)
        info = system.get_file_info(partition.folder)
        if info.type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(partition.folder, recursive=partition.deep, allow_not_found=True))
        else:
            found = [info]
        now = time.time_ns() // 1_000_000
        for f in found:
            if f.type == fs.FileType.File and taken(f.path, root):
                yield prefix + f.path, (f.mtime_ns or 0) // 1_000_000, f.size or 0, now

    def commit(self, end: dict) -> None:
        pass


class Listings(DataSource):
    """Stream of the files below ``paths`` (a JSON list), all of them in each batch."""

    @classmethod
    def name(cls) -> str:
        return "file_listings"

    def schema(self) -> str:
        return LISTED

    def streamReader(self, schema) -> Listing:
        return Listing(json.loads(self.options["paths"]))


def told(quiet_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The step of one file's state: which change, if any, is told now.  Its timer runs while no listing has the file."""

    def row(source: str, mtime: int, length: int, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"source": [source], "mtime": [pd.Timestamp(mtime, unit="ms")], "length": [length], "kind": [kind]})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, _, _, mtime, length = state.get
            state.remove()
            if mtime >= 0:
                yield row(key[0], mtime, length, "removed")
            return
        seen, mtime, length = max((int(s), int(m), int(n)) for p in parts for s, m, n in zip(p["seen"], p["mtime"], p["length"], strict=True))
        was_mtime, was_length, since, told_mtime, told_length = state.get if state.exists else (-1, -1, seen, -1, -1)
        if (mtime, length) != (was_mtime, was_length):
            since = seen
        if seen - since >= quiet_ms and (mtime, length) != (told_mtime, told_length):
            yield row(key[0], mtime, length, "added" if told_mtime < 0 else "changed")
            told_mtime, told_length = mtime, length
        state.update((mtime, length, since, told_mtime, told_length))
        state.setTimeoutDuration(max(1, quiet_ms))

    return step


def changes(spark: SparkSession, paths: Sequence[str], quiet_ms: int = QUIET_MS) -> DataFrame:
    """A streaming DataFrame (source, mtime, length, kind) of the files below ``paths`` that were added, changed or removed."""
    spark.dataSource.register(Listings)
    listed = spark.readStream.format(Listings.name()).option("paths", json.dumps(list(paths))).load()
    return listed.groupBy("source").applyInPandasWithState(told(quiet_ms), TOLD, KNOWN, "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(memory, paths: Sequence[str], interval: str, on_error: Callable[[Exception], None], quiet_ms: int = QUIET_MS, forget_removed: bool = False):
    """Ingest ``paths`` now and the files that change from now on; the streaming query.

    Removed files stay in the store unless ``forget_removed``.
    """
    failed, started = False, []

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal failed
        found = written(rows, "changes")  # read whole, once: that is what moves the state on
        stream = memory.spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        try:
            if failed:
                memory.ingest(paths)
                failed = False
            if memory.store.state.get("watched", {}).get(stream, -1) < number and not found.isEmpty():
                gone = found.where("kind = 'removed'").select("source") if forget_removed else None
                memory.ingest_files(paths, found.where("kind <> 'removed'").drop("kind"), gone, {stream: number})
        except Exception as e:
            if started and not started[0].isActive:
                raise  # cut off by the stop: the batch comes again when the watch is restarted
            failed = True
            on_error(e)

    memory.ingest(paths)
    name = hashlib.sha256(json.dumps(sorted(paths)).encode()).hexdigest()[:16]
    stream = changes(memory.spark, paths, quiet_ms).writeStream.foreachBatch(batch).option("checkpointLocation", f"{memory.path}/watch-{name}")
    started.append(stream.trigger(processingTime=interval).start())
    return started[0]
