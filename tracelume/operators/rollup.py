"""Summaries. Everything is an aggregate that combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelume.functions import expr


def session_summary(calls: DataFrame, by: str = "session_id") -> DataFrame:
    """Calls, failures by kind, retries and token sums of each session; calls without usage add nothing."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias
    return calls.groupBy(by).agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "aborted").alias("aborts"),
        F.count_if(F.col("attempt") > 1).alias("retried"),
        total(expr.billed_input(F.col("input_tokens"), F.col("cache_read"), F.col("cache_write")))("billed"),
        total(F.col("input_tokens"))("input"),
        total(F.col("cache_read"))("cache_read"),
        total(F.col("cache_write"))("cache_write"),
        total(F.col("output_tokens"))("output"),
    )


def model_tally(calls: DataFrame) -> DataFrame:
    """Calls of each session, provider and model, and where the pair first appears."""
    return calls.groupBy("session_id", "provider", "model").agg(F.count("*").alias("n_calls"), F.min("pos").alias("first_pos"))


def footprint(lines: DataFrame) -> DataFrame:
    """Bytes of each session's lines (with their newlines) and of the objects they account for; rows only."""
    return lines.groupBy("session_id").agg(F.sum(F.col("line_bytes") + 1).alias("envelope_bytes"), F.sum(F.coalesce("object_bytes", F.lit(0))).alias("object_bytes"))


def dispatch_counts(calls: DataFrame, names: str = "names") -> DataFrame:
    """``call, dispatches, total``: how often each name is called, in order of first appearance.

    ``calls(call, names array<string>)``; a call's names are few, so they are folded in place.
    """
    found = F.array_distinct(names)
    count = lambda n: F.size(F.filter(names, lambda x: x == n)).cast("long")
    return calls.select("call", F.transform(found, lambda n: F.struct(n.alias("name"), count(n).alias("count"))).alias("dispatches"), F.size(names).cast("long").alias("total"))


def token_buckets(calls: DataFrame, minutes: int) -> DataFrame:
    """Token sums per session and window, windows without calls included.

    Windows are counted from local midnight of the session's first day. ``call_id`` is the
    window's first call in the log's order, empty for none; null usage adds nothing.
    """
    width = max(1, min(1440, minutes)) * 60_000
    # one shuffle, of the calls: the windows between two of a session are made where the first of them stands
    by = Window.partitionBy("session_id")
    first = F.min("started_at").over(by)
    placed = calls.where("started_at is not null").withColumn("_lo", first)
    placed = placed.withColumn("bucket", expr.bucket_start(F.col("started_at"), width, expr.local_midnight(F.col("_lo"))))
    names = ("cache_read", "input_tokens", "cache_write", "output_tokens")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    sums = placed.groupBy("session_id", "bucket").agg(*[total(c) for c in names], F.coalesce(F.min_by("id", "pos").cast("string"), F.lit("")).alias("call_id"))
    step = F.lit(width).cast("long")
    until = F.coalesce(F.lead("bucket").over(by.orderBy("bucket")) - step, F.col("bucket"))
    out = sums.withColumn("_until", until).select("*", F.explode(F.sequence("bucket", "_until", step)).alias("_at"))
    own = (F.col("_at") == F.col("bucket")) & F.col("session_id").isNotNull()  # calls of no session are in no window
    zero = [F.when(own, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in names]
    return out.select("session_id", F.col("_at").alias("bucket"), *zero, F.when(own, F.col("call_id")).otherwise(F.lit("")).alias("call_id"))
