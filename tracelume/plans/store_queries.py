"""Queries over object packs made from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelume.functions import expr
from tracelume.plans.log_queries import scratch_path
from tracelume.sources import packs
from tracelume.sources.driver import read

#: Limits for tables of this size; a store's own are in ``packs``.
LIMITS = {"block_bytes": 16 << 10, "most": 20, "pack_bytes": 128 << 10}


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Every text by its hash, in order of its first document."""
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select(expr.content_hash(F.col("text")).alias("hash"), F.col("doc_id").alias("rank"), F.col("text").cast("binary").alias("body"))


def pack_layout(spark, d):
    """Which pack and block each object comes to."""
    return packs.cut(_objects(spark, d), **LIMITS).select("hash", "pack", F.col("block.bytes").alias("block"), F.col("block.entries").alias("part"))


def object_lookup(spark, d):
    """Texts of every tenth document, and hashes that no store has, found in written packs by their blocks."""
    index = packs.write(_objects(spark, d), scratch_path(spark, "packs"), **LIMITS)
    docs = read(spark, d, "documents").where("doc_id % 10 = 0 and text is not null")
    wanted = docs.select(expr.content_hash(F.when(F.col("doc_id") % 20 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?")))).alias("hash"))
    return packs.lookup(wanted, index).select("hash", F.md5("body").alias("digest"), F.octet_length("body").cast("long").alias("bytes"))


def pack_rewrite(spark, d):
    """What the index names once packs with a dead majority are rewritten; live is what the first three fifths of the documents' ids have."""
    path, objects = scratch_path(spark, "packs"), _objects(spark, d)
    packs.write(objects, path, **LIMITS)
    last = objects.agg(F.max("rank")).first()[0] or 0
    live = objects.where((F.col("rank") * 5 < last * 3) | (F.col("rank") % 7 == 0)).select("hash")
    packs.repack(spark, path, live, **LIMITS)
    return packs.read_index(spark, path).groupBy("hash").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pack_layout, object_lookup, pack_rewrite)}


_OBJECTS = f"""o as (select sha256(text) as hash, min(doc_id) as rank, any_value(text) as text, strlen(any_value(text)) as z from documents where text is not null group by 1),
s as (select *, sum(z) over (order by rank) - z as upto, row_number() over (order by rank) - 1 as n from o),
p as (select hash, rank, cast(upto // {LIMITS['pack_bytes']} as bigint) as pack, cast(upto // {LIMITS['block_bytes']} as bigint) as block, cast(n // {LIMITS['most']} as bigint) as part from s)"""


def oracle_sql() -> dict[str, str]:
    return {
        "pack_layout": f"with {_OBJECTS} select hash, pack, block, part from p",
        "object_lookup": "select distinct sha256(text) as hash, md5(text) as digest, strlen(text)::bigint as bytes from documents where doc_id % 20 = 0 union select sha256(text), md5(text), strlen(text)::bigint from documents where sha256(text) in (select sha256(text || '?') from documents where doc_id % 20 = 10)",
        "pack_rewrite": f"""with {_OBJECTS}, l as (select distinct sha256(text) as hash from documents where doc_id * 5 < (select max(doc_id) * 3 from documents where text is not null) or doc_id % 7 = 0),
q as (select pack, count(l.hash) * 2 < count(*) as worn from p left join l using (hash) group by 1)
select hash, 1::bigint as n from p join q using (pack) where not worn or hash in (select hash from l)""",
    }
