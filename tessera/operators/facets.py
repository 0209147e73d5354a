"""Facets under filters from bitmaps: one per facet value and bucket of rows, so that a page of facets reads no rows.

Rows are numbered; the bit of a row's number is set in the bitmap of each of its facet values. Values within a facet are
alternatives (or), facets narrow each other (and), and counts are set bits: aggregations over the index alone, spread
over buckets of 32,768 rows. Meant for facets of few values: a value costs 4 kB for each bucket that it occurs in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap_index(df: DataFrame, ordinal: str, facets: dict[str, str]) -> DataFrame:
    """facet, value, bucket, bits. ``ordinal``: a number per row, from 0, best without large gaps; facets: name -> column.

    Null is a value of its own.
    """
    pairs = F.array(*(F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in facets.items()))
    rows = df.select((F.col(ordinal).cast("long") + 1).alias("bit"), F.inline(pairs))  # Spark counts bits from one
    return rows.groupBy("facet", "value", F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))


def selection(index: DataFrame, filters: dict[str, list[str | None]]) -> DataFrame:
    """bucket, bits of the rows that have one of the given values in each of the given facets."""
    wanted = [(F.col("facet") == name) & ((F.col("value").isin([v for v in values if v is not None])) | (F.col("value").isNull() & F.lit(None in values))) for name, values in filters.items()]
    some = wanted[0]
    for w in wanted[1:]:
        some = some | w
    either = index.filter(some).groupBy("facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = either.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.filter(F.col("n") == len(filters)).select("bucket", "bits")


def counts_under(index: DataFrame, filters: dict[str, list[str | None]] | None = None) -> DataFrame:
    """facet, value, n of every value that some row under the filters has."""
    if filters:
        chosen = selection(index, filters)
        own = index.join(chosen.select("bucket"), "bucket", "left_semi").select("facet", "value", "bucket", "bits")
        each = own.select("facet", "value", "bucket").join(chosen, "bucket").select("facet", "value", "bucket", "bits")
        index = own.unionByName(each).groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return index.groupBy("facet", "value").agg(F.sum(F.bitmap_count("bits")).alias("n")).filter("n > 0")


def ordinals(selected: DataFrame) -> DataFrame:
    """The numbers of a selection's rows, from 0."""
    byte = F.expr("conv(hex(substring(bits, i + 1, 1)), 16, 10)").cast("int")
    rows = selected.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("i")).withColumn("byte", byte).filter("byte > 0")
    rows = rows.select("bucket", "i", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).filter("shiftright(byte, k) % 2 = 1")
    return rows.select(((F.col("bucket") - 1) * 32768 + F.col("i") * 8 + F.col("k")).cast("long").alias("ordinal"))
