"""Exact order statistics of many groups at once, without sorting or gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.session import broadcast_if_small, drop_settled, settle

#: Parts that a range of values is cut into each round.
BINS = 1_024


def values_at(rows: DataFrame, value: str, places: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, value): what stands at each place (from 0) of a group's values in rising order; nulls and what isn't finite are left out.

    ``places``: (by..., name, place). The range of values in which a place lies is cut
    into ``BINS`` equal parts, the rows of each are counted, with partial
    aggregates, and the part with the place is the range of the next round, from
    its least to its largest value, until these are one. Values are doubles. A
    place that the group doesn't have gives no row; null groups are groups.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in by]
    number = F.col(value).cast("double")
    own = settle(rows.where(F.abs(number) < float("inf")).select(F.xxhash64(F.lit(0), *keys).alias("_g"), F.concat_ws("\x1f", F.lit(""), *keys).alias("_k"), number.alias("_v")), "values")
    named = settle(places.select("*", F.xxhash64(F.lit(0), *keys).alias("_g"), F.concat_ws("\x1f", F.lit(""), *keys).alias("_k")), "places")
    ends = own.groupBy("_g", "_k").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    ranges = settle(named.join(ends, ["_g", "_k"]).where("place >= 0 and place < n").select("_g", "_k", "name", "place", "lo", "hi"), "ranges")
    found = ranges.where("lo = hi").select("_g", "_k", "name", F.col("lo").alias("value"))
    before = Window.partitionBy("_g", "_k", "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while ranges.where("lo < hi").limit(1).count():
        live = broadcast_if_small(settle(ranges.where("lo < hi"), "open-ranges"), 64)
        met = own.join(live, ["_g", "_k"]).where("_v >= lo and _v <= hi")
        part = F.least(F.lit(BINS - 1), F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS))
        counts = met.groupBy("_g", "_k", "name", "place", part.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        rest = counts.withColumn("place", F.col("place") - F.coalesce(F.sum("n").over(before), F.lit(0))).where("place >= 0 and place < n")
        ranges = settle(rest.select("_g", "_k", "name", "place", "lo", "hi"), "ranges")
        found = found.union(ranges.where("lo = hi").select("_g", "_k", "name", F.col("lo").alias("value")))
    drop_settled(own)
    return named.join(found, ["_g", "_k", "name"]).select(*by, "name", "value")
