"""Rows of the ledger as shown, and small projections beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelume.functions import expr, text


def ledger_rows(calls: DataFrame, with_date: bool = False) -> DataFrame:
    """``id`` and twelve texts: time, model and its badges, first chunk, duration, speed, billed, input,
    cache hits, hit rate, cache writes, output, messages and tools. What is unknown is a dash."""
    usage = F.col("output_tokens").isNotNull()
    u = [F.col(c) for c in ("input_tokens", "cache_read", "cache_write")]
    billed = F.when(usage, expr.billed_input(*u))
    s = expr.speed(F.col("output_tokens"), F.col("duration_ms"), F.col("ttfb_ms"))
    clock = F.date_format(F.timestamp_millis(F.col("started_at")), "MM-dd HH:mm:ss" if with_date else "HH:mm:ss")
    step = F.col("step").cast("string") if "step" in calls.columns else F.lit(None).cast("string")
    again = F.when(F.col("attempt") > 1, F.concat(F.lit("×"), F.col("attempt").cast("string")))
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(text.DASH)) if c in calls.columns else F.lit(text.DASH)
    number = lambda c: text.tokens_text(c.cast("double"))
    rows = calls.withColumns({"_s": s, "_billed": billed})
    return rows.select(
        "id",
        F.coalesce(clock, F.lit(text.DASH)).alias("time"),
        F.concat_ws("\u0000", F.col("model"), F.concat(F.lit("#"), step), F.col("purpose"), again).alias("model"),
        text.duration_text(F.col("ttfb_ms").cast("double")).alias("ttft"),
        text.duration_text(F.col("duration_ms").cast("double")).alias("total"),
        F.concat(F.when(F.col("_s.approx"), "≈ ").otherwise(""), text.rate_text(F.col("_s.tps"))).alias("speed"),
        number(F.col("_billed")).alias("billed"),
        number(u[0]).alias("input"),
        number(u[1]).alias("hit"),
        text.percent_text(u[1].cast("double"), F.col("_billed").cast("double")).alias("hit_pct"),
        number(u[2]).alias("write"),
        number(F.col("output_tokens")).alias("output"),
        F.concat_ws("/", count("message_count"), count("tool_calls")).alias("messages"),
    )


def spans_days(calls: DataFrame) -> DataFrame:
    """Per session, whether its first and last call fall on different local dates."""
    day = F.to_date(F.timestamp_millis(F.col("started_at")))
    return calls.groupBy("session_id").agg((F.min(day) != F.max(day)).alias("spans_days"))


def shows_reasoning(tokens: Column) -> Column:
    return F.coalesce(tokens > 0, F.lit(False))


def bare_messages(messages: Column) -> Column:
    """Id, role and content of messages; whatever else an adapter left in them goes."""
    return F.transform(messages, lambda m: F.struct(m["id"].alias("id"), m["role"].alias("role"), m["content"].alias("content")))


def with_sums(calls: DataFrame) -> DataFrame:
    """``sum``: what a list needs of a record, computed once when it is written."""
    names = ("message_count", "request_chars", "tool_calls", "called_tools", "tool_names", "input_tokens", "output_tokens", "cache_read", "cache_write", "finish_kind", "finish_message")
    return calls.withColumn("sum", F.struct(*[F.col(c) for c in names if c in calls.columns]))


