"""Sets of ids as split-block Bloom filters: rows of 4 KiB, as many as the number of ids asks for.

An id sets ``HASHES`` bits of one block, so a filter is read and joined by blocks and never lies in one piece anywhere; building it
shuffles blocks of bits, not ids.  An id of the set is always found; of others about one in a thousand is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID, HASHES, BLOCK_BITS = 16, 6, 32768


def blocks_for(n: int) -> int:
    return max(1, -(-n * BITS_PER_ID // BLOCK_BITS))


def _places(key: str, blocks: int) -> list[Column]:
    """The numbers of an id's bits, from 1, over all blocks."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)) * BLOCK_BITS
    return [block + F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) + 1 for i in range(HASHES)]


def build(ids: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, bits of the ids; a null id isn't in the set."""
    each = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(key, blocks))).alias("at"))
    return each.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def may_hold(rows: DataFrame, key: str, found: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` may be in the set; the rows meet their blocks, of which only those with a row are kept."""
    places = _places(key, blocks)
    known = found.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    joined = rows.where(F.col(key).isNotNull()).join(known, F.bitmap_bucket_number(places[0]) == F.col("_block"))
    for p in places:
        at = F.bitmap_bit_position(p).cast("int")
        byte = F.ascii(F.decode(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        joined = joined.where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1)
    return joined.select(*[rows[c] for c in rows.columns])
