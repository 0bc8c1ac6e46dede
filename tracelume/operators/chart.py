"""Chart models as long tables: (session, x, series, y), null y being a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelume.functions import expr

# Groups, their series, and the order in which tokens pile up.
GROUPS = {"hitrate": ("hitRate",), "tokens": ("in", "cacheRead", "cacheWrite", "out"), "latency": ("duration", "ttfb"), "speed": ("tps",)}
STACK = ("cacheRead", "in", "cacheWrite", "out")


def with_metrics(calls: DataFrame) -> DataFrame:
    """Hit rate, billed input, output speed and its approximation flag, stream and wait times."""
    u = [F.col(c) for c in ("input_tokens", "cache_read", "cache_write")]
    speed = expr.speed(F.col("output_tokens"), F.col("duration_ms"), F.col("ttfb_ms"))
    return (
        calls.withColumns({"hit_rate": expr.hit_rate(*u), "_s": speed, "_p": expr.phases(F.col("duration_ms"), F.col("ttfb_ms"))})
        .withColumns({"billed": F.when(F.col("output_tokens").isNotNull(), expr.billed_input(*u)), "tps": F.col("_s.tps"), "tps_approx": F.col("_s.approx"), "stream_ms": F.col("_p.stream")})
        .drop("_s", "_p")
    )


def collapse_steps(calls: DataFrame) -> DataFrame:
    """One row per session and step: of its attempts in time order, a later one replaces the kept
    one if it has a higher number, or usage where the kept has none."""
    cols = [c for c in calls.columns if c not in ("session_id", "step")]
    rows = F.array_sort(F.collect_list(F.struct("started_at", "pos", F.struct(*cols).alias("c"))))
    groups = calls.where("purpose is null and step is not null").groupBy("session_id", "step").agg(rows.alias("rows"))
    usage = lambda c: c["output_tokens"].isNotNull()
    better = lambda a, x: (x["attempt"] > a["attempt"]) | (usage(x) & ~usage(a))
    rest = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    kept = F.aggregate(rest, F.col("rows")[0]["c"], lambda a, x: F.when(better(a, x["c"]), x["c"]).otherwise(a))
    return groups.select("session_id", "step", kept.alias("c")).select("session_id", "step", "c.*")


def series(rows: DataFrame, x: str) -> DataFrame:
    """Long form ``session_id, pos, x, series, y, approx`` of rows with metrics."""
    u = lambda c: F.when(F.col("output_tokens").isNotNull(), F.coalesce(c, F.lit(0))).cast("double")
    values = {"hitRate": F.col("hit_rate"), "in": u("input_tokens"), "cacheRead": u("cache_read"), "cacheWrite": u("cache_write"), "out": u("output_tokens")}
    values |= {"duration": F.col("duration_ms").cast("double"), "ttfb": F.col("ttfb_ms").cast("double"), "tps": F.col("tps")}
    points = F.array(*[F.struct(F.lit(k).alias("series"), v.alias("y")) for k, v in values.items()])
    approx = (F.col("p.series") == "tps") & F.coalesce("tps_approx", F.lit(False)) & F.col("p.y").isNotNull()
    return rows.select("session_id", "pos", F.col(x).cast("long").alias("x"), "tps_approx", F.explode(points).alias("p")).select("session_id", "pos", "x", "p.series", "p.y", approx.alias("approx"))


def step_series(calls: DataFrame) -> DataFrame:
    """Series over step numbers; ``calls`` have steps."""
    return series(with_metrics(collapse_steps(calls)), "step")


def time_series(calls: DataFrame, aux: bool = False) -> DataFrame:
    """Series over time, one point per attempt; calls with a purpose only if ``aux``."""
    return series(with_metrics(calls if aux else calls.where("purpose is null")), "started_at")


def excluded(calls: DataFrame) -> DataFrame:
    """Per session, the calls that a step axis cannot hold."""
    return calls.groupBy("session_id").agg(F.count_if(F.col("purpose").isNotNull() | F.col("step").isNull()).alias("excluded"))


def stacked(points: DataFrame, order: tuple[str, ...] = STACK, hidden: tuple[str, ...] = ()) -> DataFrame:
    """``top``: each visible layer's running sum at its x; a null layer stays null and carries the base."""
    points = points.where(F.col("series").isin(*[s for s in order if s not in hidden]))
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("series"))
    by = Window.partitionBy("session_id", "pos", "x").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("top", F.when(F.col("y").isNotNull(), F.sum("y").over(by)))


def finite(y: str = "y"):
    c = F.col(y)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def runs(points: DataFrame) -> DataFrame:
    """``run``: number of the gap-free stretch of its series that a finite point is in; other points go."""
    by = Window.partitionBy("session_id", "series").orderBy("x", "pos")
    gaps = F.sum((~finite()).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = points.withColumn("_gaps", gaps).where(finite())
    return kept.withColumn("run", F.dense_rank().over(Window.partitionBy("session_id", "series").orderBy("_gaps"))).drop("_gaps")


def extent(points: DataFrame, *by: str) -> DataFrame:
    """Least and greatest finite y, null for none."""
    y = F.when(finite(), F.col("y"))
    return points.groupBy(*by).agg(F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def bar_columns(points: DataFrame, width: int) -> DataFrame:
    """Of each stride of slots, the last that has any layer; as many strides as ``width``, 40 at least."""
    any_y = points.groupBy("session_id", "pos", "x").agg(F.max(F.col("y").isNotNull()).alias("drawn"))
    slots = any_y.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("x", "pos")) - 1)
    n = F.count("*").over(Window.partitionBy("session_id"))
    slots = slots.withColumn("stride", F.greatest(F.lit(1), F.ceil(n / max(40, width))))
    return slots.where("drawn").groupBy("session_id", F.floor(F.col("idx") / F.col("stride")).alias("bar")).agg(F.max("idx").cast("long").alias("idx"), F.max_by("x", "idx").alias("x"))
