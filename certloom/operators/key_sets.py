"""A set of texts as a hashed bitmap literal, so that a row can drop what is not in the set before it is exploded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16  # one absent text in 16 passes
USED_BITS = 7  # of a byte, so that each byte is an ASCII character, which is what can be read off quickly
BLOCK_BYTES = 4096  # the size of Spark's bitmaps
MOST_BYTES = 1 << 20  # the literal goes into the plan; larger sets let more texts pass


@dataclass(frozen=True)
class KeySet:
    """The bitmap of a set of texts."""

    bitmap: bytes

    def may_hold(self, text: Column) -> Column:
        """False only for texts that are not in the set."""
        place = F.pmod(F.xxhash64(text), F.lit(USED_BITS * len(self.bitmap)).cast("long"))
        byte = F.floor(place / USED_BITS).cast("int") + 1
        bits = F.ascii(F.substr(F.lit(self.bitmap), byte, F.lit(1)).cast("string"))
        return F.getbit(bits, (place % USED_BITS).cast("int")) == 1


def key_set(keys: DataFrame, column: str, count: int) -> KeySet:
    """The set of the texts in a column, of which there are about `count`. At most MOST_BYTES reach the driver."""
    size = BLOCK_BYTES
    while size * USED_BITS < count * BITS_PER_KEY and size < MOST_BYTES:
        size *= 2
    place = F.pmod(F.xxhash64(column), F.lit(USED_BITS * size).cast("long"))
    bit = F.floor(place / USED_BITS) * 8 + place % USED_BITS
    block_bits = BLOCK_BYTES * 8
    blocks = (
        keys.select(F.floor(bit / block_bits).alias("block"), (bit % block_bits).cast("long").alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bitmap = bytearray(size)
    for r in blocks:
        bitmap[r["block"] * BLOCK_BYTES : (r["block"] + 1) * BLOCK_BYTES] = r["bits"]
    return KeySet(bytes(bitmap))
