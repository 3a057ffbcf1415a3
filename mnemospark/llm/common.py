"""Shared plumbing of the training-data operators.

* ``scratch``/``persist``: tables in the shared folder of ``spark.checkpoint.dir``.  They cut the
  lineage and survive the loss of an executor; nothing is kept on an executor's own disk.
* ``attach_groups``: give each row of a group its group's values although one group may hold a third
  of all rows.
* ``tidied``: Python tasks that leave no unused memory in their worker.
* ``bitmap_of``/``in_bitmap``: a set of keys as a bitmap of fixed size, for filters before a shuffle.
"""

from __future__ import annotations

import atexit
import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()
_roots: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared checkpoint folder; where none is set, a local one is used on a single machine alone."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "/tmp/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/mnemospark-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return f"{_roots[app]}/{name}-{next(_serial)}"


def _remove(spark: SparkSession, root: str) -> None:
    """Delete this application's scratch tables when the driver ends."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back()
    return spark.read.schema(df.schema).parquet(path)


#: What a worker holds between the tasks of one stage; the tasks of any other stage drop it.
held: dict[tuple, object] = {}


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives the memory that its task has freed back to the system; with ``keep`` what is ``held`` stays.

    Workers are reused and share an executor's memory with the JVM: what one stage's tasks hold on to, the next stage lacks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mnemospark.llm import common  # the worker's own module, not a copy of it

        if not keep:
            common.held.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let fewer rows travel to Python workers at once than Spark's 10,000: whole texts are long, and stages share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The whole text; null counts as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_hash(column: str = "doc_id") -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def partitions_for(df: DataFrame, target_bytes: int = 64 << 20) -> int:
    """Partitions for a shuffle of whole rows of ``df``: by its size, at least the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, -(-size // target_bytes)))


#: A group with more than this share of all rows is hot.  Fewer than 1 / HOT_SHARE groups can be, whatever the input.
HOT_SHARE = 1 / 500
HOT_LEAST = 500


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, named: bool = False) -> DataFrame:
    """``rows`` left-joined with ``groups`` on ``key`` (one row of groups for each key; null keys match nothing).

    Hot groups (``size`` over ``total * HOT_SHARE``: at most 500, so their broadcast is bounded) are
    joined where their rows stand; the rows of all other groups meet in a shuffled join, in which rows that
    are already served, or have a null key, get a spread-out key whose match, if any, is ignored.  ``named``: the hot groups (at most
    500) are read to the driver and looked up by name, so the rows of ordinary groups don't pass through a join for them.
    """
    if key in groups.columns and len(groups.columns) == 1:
        raise ValueError("groups has no values to attach")
    limit = max(HOT_LEAST, int(total * HOT_SHARE))
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_ck"), F.struct(*values).alias("_cold"))
    kind = rows.schema[key].dataType
    if named:
        joined = rows.withColumn("_hot", _looked_up(hot, key))
    else:
        joined = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").drop("_hk")
    spread = F.xxhash64(*[F.col(c) for c in rows.columns])
    spread = (spread.cast("string") if kind.typeName() == "binary" else spread).cast(kind)
    joined = joined.withColumn("_rs", F.col("_hot").isNull() & F.col(key).isNotNull())
    joined = joined.withColumn("_rk", F.when(F.col("_rs"), F.col(key)).otherwise(spread))
    joined = joined.join(cold, F.col("_rk") == F.col("_ck"), "left")
    found = F.when(F.col("_rs"), F.col("_cold"))
    return joined.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col("_hot")[v], found[v]).alias(v) for v in values])


def _looked_up(hot: DataFrame, key: str) -> Column:
    """The values ``_hot`` of the groups ``_hk``, a bounded number, as an expression of ``key``."""
    kinds, found = hot.schema["_hot"].dataType, hot.collect()
    plain = lambda v: F.lit(bytearray(v) if isinstance(v, bytes) else v)
    if not found:
        return F.lit(None).cast(kinds)
    names = [plain(r["_hk"]).cast(hot.schema["_hk"].dataType) for r in found]
    values = [F.struct(*[plain(v).cast(f.dataType).alias(f.name) for v, f in zip(r["_hot"], kinds, strict=True)]) for r in found]
    of = F.map_from_arrays(F.array(*names), F.array(*values))
    return F.when(F.col(key).isin(names), F.element_at(of, F.col(key))).cast(kinds)


def bitmap_of(keys: DataFrame, key: Column, bits: int = 23) -> DataFrame:
    """The set of ``key`` (a long hash) as at most ``2**bits / 32768`` rows of 4 KiB: its size is bounded by ``bits``."""
    k = F.pmod(key, F.lit(1 << bits)) + F.lit(1)
    return keys.select(k.alias("k")).groupBy(F.bitmap_bucket_number("k").alias("_bm_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_bm"))


def in_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, out: str, bits: int = 23) -> DataFrame:
    """``df`` with a boolean column ``out``: false only for keys that aren't in the set (true also for a few others).

    ``df`` mustn't have a column of that name; its other columns may have any names.
    """
    k, at, row, bits_of = (f"{out}_{x}" for x in ("key", "at", "row", "bits"))
    known = bitmap.select(F.col("_bm_row").alias(row), F.col("_bm").alias(bits_of))
    df = df.select(*[df[_quoted(c)] for c in df.columns], (F.pmod(key, F.lit(1 << bits)) + F.lit(1)).alias(k))
    joined = df.withColumn(at, F.bitmap_bit_position(k).cast("int")).join(F.broadcast(known), F.bitmap_bucket_number(k) == F.col(row), "left")
    byte = F.ascii(F.decode(F.substring(F.col(bits_of), F.floor(F.col(at) / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    bit = F.expr(f"shiftleft(1, {at} % 8)")
    hit = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    return joined.withColumn(out, hit).drop(bits_of, k, row, at)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _free(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has columns that begin with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def text_key(df: DataFrame, column: str = "text") -> Column:
    """A hash of the whole text.  With doc_id it names a row; rows that share both are the same row repeated."""
    return F.xxhash64(text_of(df, column))


def _by_key(docs: DataFrame, keys: DataFrame, bits: int, how: str) -> DataFrame:
    own = _free(docs, "__ms")
    hashed, tk, hit, ki, kt = F.xxhash64("doc_id", "text_key"), f"{own}_tk", f"{own}_hit", f"{own}_ki", f"{own}_kt"
    mark = docs.withColumn(tk, text_key(docs))
    mark = in_bitmap(mark, F.xxhash64("doc_id", tk), persist(bitmap_of(keys, hashed, bits), "row-keys"), hit, bits)
    names = keys.select(F.col("doc_id").alias(ki), F.col("text_key").alias(kt))
    maybe = mark.where(F.col(hit)).join(names, F.col("doc_id").eqNullSafe(F.col(ki)) & (F.col(tk) == F.col(kt)), how)
    out = maybe if how == "left_semi" else mark.where(~F.col(hit)).unionByName(maybe)
    return out.select(*[out[_quoted(c)] for c in docs.columns])


def rows_without(docs: DataFrame, keys: DataFrame, bits: int = 23) -> DataFrame:
    """``docs`` without the rows named by ``keys`` (doc_id, text_key); only rows that may be named are shuffled."""
    return _by_key(docs, keys, bits, "left_anti")


def rows_matching(docs: DataFrame, keys: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (doc_id, text_key)."""
    return _by_key(docs, keys, bits, "left_semi")
