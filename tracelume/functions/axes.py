"""Axes of many charts at once, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelume.functions.ticks import CADENCES, MOST

DAY = CADENCES[-1] * 1000


def _local(ms: Column, zone: Column) -> Column:
    """The zone's clock at ``ms``, as if it were UTC."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def time_ticks(lo: Column, hi: Column, zone: Column | str = "UTC") -> Column:
    """Ticks between two times in milliseconds, on the zone's own boundaries: array<bigint>.

    The cadence is the shortest that gives at most seven steps, a day beyond that. Shorter ones divide a
    local day, from the offset at ``lo``; days step by date, as one may have 23 or 25 hours. Without a tick
    between, or without a span, ``lo`` alone; null for null.
    """
    zone = F.lit(zone) if isinstance(zone, str) else zone
    span = hi - lo
    cadence = F.coalesce(*[F.when(span / (c * 1000) <= MOST, F.lit(c * 1000).cast("long")) for c in CADENCES], F.lit(DAY).cast("long"))
    shift = _local(lo, zone) - lo
    first = (F.ceil((lo + shift) / cadence) * cadence - shift).cast("long")
    some = F.when(first <= hi, F.sequence(first, F.greatest(hi, first), cadence))
    days = F.sequence(F.floor(_local(lo, zone) / DAY), F.floor(_local(hi, zone) / DAY))
    midnights = F.transform(days, lambda d: F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(d * DAY), zone)))
    whole = F.filter(midnights, lambda t: (t >= lo) & (t <= hi))
    found = F.when(cadence < DAY, some).otherwise(whole)
    return F.when(lo.isNull() | hi.isNull(), F.lit(None).cast("array<bigint>")).when(span <= 0, F.array(lo.cast("long"))).otherwise(F.when(F.size(found) > 0, found).otherwise(F.array(lo.cast("long"))))


def nearest(probes: DataFrame, points: DataFrame, by: list[str], at: str = "v", x: str = "x") -> DataFrame:
    """``probes`` with ``nearest``: of the points of its group the ``x`` next to its ``at``, the lower of two as near; null if the group has none.

    Both tables are ordered together, and a probe takes the last point up to it and, in the order reversed, the last down to
    it: both frames begin at the start, so each only grows. No pairs are made. Null and non-finite points are none, and a null probe has no nearest.
    """
    columns = probes.columns
    sound = points.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) < float("inf")))
    row = F.struct(*[F.col(c) for c in columns])
    left = probes.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.col(at).cast("double").alias("_at"), F.lit(None).cast("double").alias("_x"), row.alias("_row"))
    right = sound.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.col(x).cast("double").alias("_at"), F.col(x).cast("double").alias("_x")).withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType))
    keys = [f"_k{k}" for k in range(len(by))]
    both = left.union(right)
    # a frame up to the end is walked anew for each row
    up_to = lambda order: F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    below, above = up_to(F.asc("_at")), up_to(F.desc("_at"))
    found = both.withColumns({"_lo": below, "_hi": above}).where("_row is not null")
    lower = F.col("_hi").isNull() | (F.col("_at") - F.col("_lo") <= F.col("_hi") - F.col("_at"))
    return found.select("_row.*", F.when(F.col("_at").isNotNull(), F.when(lower & F.col("_lo").isNotNull(), F.col("_lo")).otherwise(F.col("_hi"))).alias("nearest"))
