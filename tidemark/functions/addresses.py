"""Record addresses: 28 bits of segment, 36 bits of a place in the segment.

The low four bits and the six below a block's 64-byte boundary share the record's number in its block (up to 1023).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the address format: bits of a place in a segment, alignment of blocks, bits of a record's number.
PLACE_BITS = 36
PAD = 64
INDEX_BITS = 10
SHIFT = 4


def packed(segment: Column, block: Column, record: Column) -> Column:
    return F.shiftleft(segment.cast("long"), PLACE_BITS) + F.shiftleft(block.cast("long"), SHIFT) + record.cast("long")


def segment(address: Column) -> Column:
    return F.shiftrightunsigned(address, PLACE_BITS)


def block(address: Column) -> Column:
    return F.shiftrightunsigned(address.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), SHIFT).bitwiseAND(F.lit(~(PAD - 1)))


def record(address: Column) -> Column:
    return address.bitwiseAND(F.lit((1 << INDEX_BITS) - 1))


def segment_address(number: Column) -> Column:
    """The first address of a segment."""
    return F.shiftleft(number.cast("long"), PLACE_BITS)


def segment_path(number: Column) -> Column:
    """Where a segment's file lies: two folder levels of a thousand, then the number."""
    return F.format_string("%03d/%03d/%09d.rec", (number / 1_000_000).cast("long"), ((number / 1000).cast("long") % 1000), number.cast("long"))


def addressed(rows, per_segment: int = 1000, per_block: int = 16):
    """Segment, block, record and address of rows numbered by ``position``."""
    at = F.col("position") % per_segment
    out = rows.withColumn("segment", F.floor(F.col("position") / per_segment).cast("long"))
    out = out.withColumn("block", F.floor(at / per_block).cast("long") * PAD).withColumn("record", (at % per_block).cast("long"))
    return out.withColumn("address", packed(F.col("segment"), F.col("block"), F.col("record")))
