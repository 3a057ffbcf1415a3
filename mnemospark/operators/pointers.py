"""Pointers: small numbered JSON files that say which folders of a table count.

Each change writes the next number, under another name first, and renames it, so a reader sees the old state or the new one, and a writer
that dies in between leaves the old one.  Two writers can't take the same number: the second one's rename fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(f"{name}-") and n.rpartition("-")[2].isdigit())


def latest(spark: SparkSession, path: str, name: str) -> dict | None:
    """The state that the last pointer has, with its ``number``; None if there is none yet."""
    numbers = _numbers(spark, path, name)
    if not numbers:
        return None
    fs, at = file_system(spark, f"{path}/{name}-{numbers[-1]:010d}")
    stream = fs.open(at)
    try:
        return {**json.loads(bytes(stream.readAllBytes()).decode()), "number": numbers[-1]}
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, name: str, state: dict, number: int | None = None) -> int:
    """Let ``state`` count from now on, as the successor of pointer ``number`` (the last one there is, if not given); its own number.

    RuntimeError if another writer has published in the meantime.
    """
    last = max(_numbers(spark, path, name), default=0)
    if number is not None and number != last:
        raise RuntimeError(f"{path}: another writer has published state {last} after {number}")
    fs, draft = file_system(spark, f"{path}/_{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "number"}).encode()))
    stream.close()
    _, final = file_system(spark, f"{path}/{name}-{last + 1:010d}")
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path}: another writer has published state {last + 1}")
    return last + 1


def forget(spark: SparkSession, path: str, name: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` pointers."""
    for n in _numbers(spark, path, name)[:-keep]:
        fs, at = file_system(spark, f"{path}/{name}-{n:010d}")
        fs.delete(at, False)
