"""Timelines of year-less ranges: one row per entity and wave, dated or vague, with sort keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import SUMMER_MONTHS, WINTER_MONTHS, for_wave, midpoint, parse_range, range_texts, wave_order
from .tables import settled


def timeline(entities: DataFrame, key: str = "id") -> DataFrame:
    """key, wave, is_dated, parsed (null: vague), pub_month, pub_day, sort_key. entities: key, summer, winter, and vacPub texts.

    A wave's texts and that of its publication are parsed by one expression, once; what fits the wave is chosen from that.
    """
    waves = F.array(*(F.struct(F.lit(w).alias("wave"), F.col(w).alias("raw"), F.col(p).alias("published")) for w, p in (("summer", "vacPubSummer"), ("winter", "vacPubWinter"))))
    rows = entities.select(key, F.inline(waves))
    ranges = F.transform(F.concat(range_texts("raw"), F.array("published")), parse_range)
    rows = settled(rows.select(key, "wave", ranges.alias("ranges")), "ranges")
    by_wave = lambda f: F.when(F.col("wave") == "summer", f(SUMMER_MONTHS)).otherwise(f(WINTER_MONTHS))
    of_wave = F.filter(F.transform(F.slice("ranges", 1, F.size("ranges") - 1), lambda r: by_wave(lambda months: for_wave(r, months))), lambda r: r.isNotNull())
    rows = settled(rows.select(key, "wave", F.get(of_wave, F.lit(0)).alias("parsed"), F.element_at("ranges", -1).alias("pub")), "parsed")
    some = F.col("parsed").isNotNull()
    order = by_wave(lambda months: wave_order(F.col("parsed.start_month"), F.col("parsed.start_day"), months))
    return rows.select(
        key, "wave", some.alias("is_dated"), "parsed", F.when(some, F.col("pub.start_month")).alias("pub_month"),
        midpoint(F.col("pub.start_day"), F.col("pub.end_day")).alias("pub_day"), F.when(some, order).alias("sort_key"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Dated rows of each wave in order, vague ones after them."""
    return rows.orderBy("wave", F.asc_nulls_last("sort_key"))
