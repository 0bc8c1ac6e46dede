"""A table that a stream keeps up to date: each micro-batch is merged once, and only the buckets that it touches are written anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelume.operators import tree
from tracelume.sources import snapshots

BUCKETS = 64


def _bucket(keys: tuple[str, ...], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys[:1]]), F.lit(buckets)).cast("int")


def sink(path: str, keys: tuple[str, ...] = ("session_id", "id"), order: str = "pos", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: rows replace loaded ones of the same ``keys``; of several in a batch the one of the greatest ``order`` stays.

    Buckets go by the first key. A snapshot names the folder of each bucket and the batch that it holds up to, so a
    batch that is run again changes nothing, and one that stopped half-way had changed nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = snapshots.latest(spark, path)
        found = snapshots._content(spark, path, number)
        if number and found["batch"] >= batch_id:
            return
        held = found.get("buckets", {})
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        fresh = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn("_bucket", _bucket(keys, buckets))
        fresh = tree.checkpointed(fresh)
        touched = [r._bucket for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
        out = fresh
        for b in touched:
            if str(b) in held:
                old = spark.read.schema(batch.schema).parquet(held[str(b)])
                out = out.union(old.join(fresh.select(*keys), list(keys), "left_anti").select(*batch.columns).withColumn("_bucket", F.lit(b)))
        part = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}"
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(part)
        now = held | {str(b): f"{part}/_bucket={b}" for b in touched}
        if not snapshots.publish(spark, path, number + 1, {"batch": batch_id, "buckets": now, "parts": [], "floors": None}):
            raise snapshots.Conflict(f"another query writes to {path}")

    return merge


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the table holds after the newest batch."""
    number = snapshots.latest(spark, path)
    held = list(snapshots._content(spark, path, number).get("buckets", {}).values()) if number else []
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
