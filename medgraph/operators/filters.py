"""Rows that a join can meet, before anything is shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 256 maps of 32,768 bits, 1 MB whatever the tables.
FILTER_BITS = 1 << 23


def passing(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` is in the one column of ``values``, and few others: a broadcast bit filter of fixed size.
    The join itself follows, so what passes by chance changes no result. ``values`` is read once more by that join."""

    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    maps = values.toDF("_v").select(place("_v").alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(place(column))).withColumn("_bit", F.bitmap_bit_position(place(column)))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = placed.join(F.broadcast(maps), "_bucket").filter(F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return met.select(*rows.columns)
