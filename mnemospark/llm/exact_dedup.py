"""Exact dedup by progressive refinement (DataFrame functions only).

Three rounds, each over what the one before left:

1. the length of the normalised text: a document whose length no other has is unique;
2. length and a hash of the first ``prefix`` characters;
3. the SHA-256 of the whole normalised text, only for documents whose (length, prefix) another shares.

Between the rounds only the surviving keys travel, as bitmaps of fixed size (``2**bits`` bits), so no text is
shuffled.  A bitmap may keep a unique document by chance; round 3 then finds it alone in its group, so the
result is exact at any size.

Defined cases: null texts are empty texts and equal to each other and to texts of white space; repeated rows
(same doc_id and text) form a group like any copies, and all rows with the kept doc_id are kept; null doc_ids
sort after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import (
    attach_groups,
    bitmap_of,
    in_bitmap,
    persist,
    rows_matching,
    rows_without,
    text_key,
    text_of,
)


def normalised(text: Column) -> Column:
    """``text`` without the characters of [\\x20\\x09-\\x0D]."""
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_dedup(docs: DataFrame, prefix: int = 64, bits: int = 23, digest: bool = False, row_key: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept for each row; with ``digest`` also text_sha256 of every normalised text, with
    ``row_key`` text_key, which names the row together with its doc_id.

    Of equal texts the row with the most code points, then the smallest doc_id, is kept.
    """
    rows = docs.select(F.col("doc_id"), text_of(docs).alias("text"))
    length = F.length("norm")
    normed = rows.select("doc_id", text_key(rows).alias("text_key"), F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))

    lengths = normed.groupBy(length.alias("n_norm")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by_length = persist(bitmap_of(lengths, F.xxhash64("n_norm"), bits), "dedup-lengths")

    prefix_key = F.xxhash64(length, F.substring("norm", 1, prefix))
    first = in_bitmap(normed, F.xxhash64(length), by_length, "hit", bits).where("hit")
    prefixes = first.groupBy(prefix_key.alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    by_prefix = persist(bitmap_of(prefixes, F.col("p"), bits), "dedup-prefixes")

    last = in_bitmap(normed, prefix_key, by_prefix, "hit", bits)
    full = F.sha2(F.col("norm").cast("binary"), 256)
    slim = persist(last.select(
        "doc_id", "text_key", F.col("n_chars").cast("long").alias("n_chars"),
        F.when(F.col("hit"), full).alias("full_hash"),
        *([full.alias("text_sha256")] if digest else [])), "dedup-hashes")

    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = slim.where(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(
        F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1").select(
        "full_hash", "n", F.col("best.doc_id").alias("best_id"))
    out = attach_groups(slim, groups, "full_hash", "n", slim.count())
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        *(["text_sha256"] if digest else []), *(["text_key"] if row_key else []))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts (of rows that repeat wholly, one stays)."""
    keyed = exact_dedup(docs, row_key=True)
    gone = persist(keyed.where("not kept").select("doc_id", "text_key").distinct(), "dedup-gone")
    twice = persist(keyed.where("kept and group_size > 1").groupBy("doc_id", "text_key").count()
                    .where("count > 1").select("doc_id", "text_key"), "dedup-twice")
    left = rows_without(docs, gone)
    again = rows_matching(left, twice)
    return rows_without(left, twice).unionByName(again.dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
