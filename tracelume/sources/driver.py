"""Deterministic projections of plain tables onto the call model, for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def calls_from_events(events: DataFrame) -> DataFrame:
    """One call per event; ``k`` is the number in ``props``."""
    k = F.get_json_object("props", "$.k").cast("long")
    ok = F.col("event_type") != "error"
    duration = (F.floor(F.col("value") * 100) + 1).cast("long")
    rows = events.withColumns({"k": k, "d": duration})
    k, d = F.col("k"), F.col("d")
    return rows.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") == "signup", "session-title").alias("purpose"),
        F.concat(F.lit("p"), (k % 2).cast("string")).alias("provider"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
        F.concat_ws("-", F.col("user_id"), k % 7).alias("request_hash"),
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.lit(1).alias("attempt"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at"),
        d.alias("duration_ms"),
        F.floor(d * (k % 10) / 10).cast("long").alias("ttfb_ms"),
        F.when(ok, k * 10).alias("input_tokens"),
        F.when(ok & (k % 5 != 0), k * 90).alias("cache_read"),
        F.when(ok & (k % 4 == 0), k * 3).alias("cache_write"),
        F.when(ok, k + 1).alias("output_tokens"),
    )


def turns_as_lists(conversations: DataFrame) -> DataFrame:
    """``session_id, pos, call, system, messages``: each assistant turn is a call with all earlier turns but system ones.

    A conversation's turns are folded in one row, as a call holds its whole history.
    """
    key = F.struct("turn", "role", "text")
    whole = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(key)).alias("t"))
    rows = whole.select("conv_id", "t", F.explode(F.filter("t", lambda x: x["role"] == "assistant")).alias("a"))
    before = F.transform(F.filter("t", lambda x: (x["role"] != "system") & (x["turn"] < F.col("a.turn"))), lambda x: x["text"])
    system = F.get(F.filter("t", lambda x: x["role"] == "system"), F.lit(0))["text"]
    return rows.select(F.col("conv_id").alias("session_id"), F.col("a.turn").alias("pos"), (F.col("conv_id") * 1000 + F.col("a.turn")).alias("call"), system.alias("system"), before.alias("messages"))
