"""Store mutations over immutable tables: each takes the stored rows and gives the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators import bloom
from mnemospark.operators.scratch import written

MAX_FEEDBACK = 500
#: Rows of small tables that are broadcast.
FEW = 200_000


def changed(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed files (source, mtime) that the store doesn't hold as they are."""
    return listing.join(stored.select("source", "mtime").distinct(), ["source", "mtime"], "left_anti")


def unchanged(listing: DataFrame, stored: DataFrame) -> DataFrame:
    return listing.join(stored.select("source", "mtime").distinct(), ["source", "mtime"], "left_semi")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, batch: DataFrame, replaced: DataFrame | None = None, key: str = "id", order: str = "seq") -> DataFrame:
    """Stored rows without those of the ``replaced`` sources, then the batch's rows whose ids are new, the first of each id.

    The stored ids stay where they are: a Bloom filter of them, whose blocks of bits are all that is shuffled, tells which rows of the batch may be
    known, and these few are looked up.
    """
    kept = stored
    if replaced is not None:
        gone = written(replaced.select("source").distinct(), "replaced")
        kept = stored.join(F.broadcast(gone) if gone.limit(FEW + 1).count() <= FEW else gone, "source", "left_anti")
    blocks = bloom.blocks_for(kept.count())
    maybe = written(bloom.may_hold(batch.select(key).distinct(), key, bloom.build(kept.select(key), key, blocks), blocks), "maybe")
    few = maybe.limit(FEW + 1).count() <= FEW
    known = kept.join(F.broadcast(maybe) if few else maybe, key).select(key).distinct()
    return kept.unionByName(first_of_each(batch.join(known, key, "left_anti"), key, order))


def forget(rows: DataFrame, needle: str) -> DataFrame:
    """Rows (of chunks or feedback) whose source doesn't contain ``needle``."""
    return rows.where(~F.col("source").contains(needle))


def events_counted(events: DataFrame) -> DataFrame:
    """terms, source, count, last_at of events (terms, source, at) that have terms."""
    return events.where(F.size("terms") > 0).select(F.array_sort(F.array_distinct("terms")).alias("terms"), "source", F.lit(1).cast("long").alias("count"), F.col("at").alias("last_at"))


def reinforce(feedback: DataFrame, events: DataFrame, limit: int | None = MAX_FEEDBACK) -> DataFrame:
    """Feedback (terms, source, count, last_at) with events (terms, source, at) counted in; the ``limit`` confirmed last stay (None: all)."""
    both = feedback.select("terms", "source", "count", "last_at").unionByName(events_counted(events))
    merged = both.groupBy("terms", "source").agg(F.sum("count").alias("count"), F.max("last_at").alias("last_at"))
    return merged if limit is None else merged.orderBy(F.desc("last_at"), "source", "terms").limit(limit)


def stats(chunks: DataFrame) -> DataFrame:
    embedded = F.count_if(F.col("embedding").isNotNull()) if "embedding" in chunks.columns else F.lit(0).cast("long")
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("sources"), embedded.alias("with_embedding"))
