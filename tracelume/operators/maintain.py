"""Keeping the store within its budgets: trims, sweeps, packing and repacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelume.operators import tree

GRACE_MS, PACK_BUDGET, LIVE_RATIO, LEAST_BYTES = 3_600_000, 64 << 20, 0.5, 8 << 20


def trim_bytes(lines: DataFrame, budget: int, by: str = "session_id") -> DataFrame:
    """The newest lines of each session whose bytes, summed from the newest, stay within the budget."""
    newest = Window.partitionBy(by).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_sum", F.sum("bytes").over(newest)).where(F.col("_sum") <= max(budget, 0)).drop("_sum")


def trim_count(lines: DataFrame, most: int, by: str = "session_id") -> DataFrame:
    """The newest ``most`` lines of each session."""
    newest = Window.partitionBy(by).orderBy(F.desc("pos"))
    return lines.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")


def garbage(objects: DataFrame, live: DataFrame, now_ms: int, grace_ms: int = GRACE_MS, complete: bool = True) -> DataFrame:
    """Objects that nothing reaches and that are older than the grace time; none if the marks are incomplete."""
    if not complete:
        return objects.limit(0)
    return objects.where(F.col("mtime_ms") < now_ms - grace_ms).join(live.select("hash"), "hash", "left_anti")


def pack_candidates(objects: DataFrame, live: DataFrame, ranks: DataFrame, cold_before_ms: int, budget: int = PACK_BUDGET) -> DataFrame:
    """Cold reachable objects in packing order, while what is taken is below the budget, unranked ones last.

    The object that reaches the budget is taken too, and something of a size above zero always is.

    Sums run in two levels: over coarse rank ranges, then within the range that the budget
    ends in, so no task sorts all objects: the first level has one row for 4,096 ranked
    objects, and unranked ones stand in as many ranges of their hash, behind the others.
    """
    cold = objects.where(F.col("mtime_ms") < cold_before_ms).join(live.select("hash"), "hash", "left_semi").join(ranks, "hash", "left")
    cold = cold.withColumn("_block", F.coalesce(F.floor((F.col("rank") - 1) / 4096), F.lit(1 << 40) + F.pmod(F.xxhash64("hash"), F.lit(4096))))
    blocks = cold.groupBy("_block").agg(F.sum("bytes").alias("_bytes"))
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_bytes").over(upto), F.lit(0))).where((F.col("_before") < budget) | (F.col("_before") == 0))
    order = Window.partitionBy("_block").orderBy(F.asc_nulls_last("rank"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    out = cold.join(blocks, "_block").withColumn("_spent", F.col("_before") + F.sum("bytes").over(order) - F.col("bytes"))
    return out.where((F.col("_spent") < budget) | (F.col("_spent") == 0)).drop("_block", "_bytes", "_before", "_spent")


def repack_candidates(entries: DataFrame, live: DataFrame, least_bytes: int = LEAST_BYTES, ratio: float = LIVE_RATIO) -> DataFrame:
    """Packs worth rewriting: with under ``ratio`` of their entries live, or, if smaller than ``least_bytes``, under half.

    ``entries(pack, hash, bytes)``; the result has ``entries, live, live_ratio, bytes``.
    """
    marked = entries.join(live.select("hash").distinct().withColumn("_live", F.lit(1)), "hash", "left")
    packs = marked.groupBy("pack").agg(F.count("*").alias("entries"), F.count("_live").alias("live"), F.sum("bytes").alias("bytes"))
    packs = packs.withColumn("live_ratio", F.col("live") / F.col("entries"))
    return packs.where(F.when(F.col("bytes") < least_bytes, 2 * F.col("live") < F.col("entries")).otherwise(F.col("live_ratio") < ratio))


def write_packed(pieces: DataFrame, path: str, row_group: int = 1 << 20) -> None:
    """Pieces as Parquet clustered by first appearance, in small row groups: what a pack is for, compressed and prunable."""
    pieces.repartitionByRange("rank").sortWithinPartitions("rank").write.option("parquet.block.size", str(row_group)).option("compression", "zstd").parquet(path)


def sweep_status(**tables: DataFrame) -> DataFrame:
    """One row per maintenance step: its name, rows and bytes."""
    out = None
    for name, df in tables.items():
        size = F.coalesce(F.sum("bytes"), F.lit(0)) if "bytes" in df.columns else F.lit(0)
        row = df.agg(F.lit(name).alias("step"), F.count("*").alias("rows"), size.cast("long").alias("bytes"))
        out = row if out is None else out.union(row)
    return out


def migration_order(sessions: DataFrame) -> DataFrame:
    """``sessions(session_id, failures, mtime_ms)`` in the order of migration: fewest failures first, then newest."""
    return sessions.orderBy("failures", F.desc("mtime_ms"), "session_id")


def sweep(objects: DataFrame, roots: DataFrame, nodes: DataFrame, ranks: DataFrame, packed: DataFrame, now_ms: int, cold_before_ms: int, budget: int = PACK_BUDGET, grace_ms: int = GRACE_MS, least_bytes: int = LEAST_BYTES) -> dict[str, DataFrame]:
    """One sweep: ``live``, what to ``collect``, ``pack`` and ``repack``, and its ``status``.

    ``objects(hash, bytes, mtime_ms)``, ``roots(hash)``, ``nodes(hash, parent)``, ``ranks(hash, rank)``,
    ``packed(pack, hash, bytes)``. Marks that are incomplete, as a reached node is missing,
    collect nothing; ``status`` has the missing nodes as a step of their own.
    """
    live = tree.reachable(roots, nodes)
    gone = tree.missing(live, nodes)
    found = {
        "live": objects.join(live, "hash", "left_semi"),
        "missing": gone,
        "collect": garbage(objects, live, now_ms, grace_ms, gone.isEmpty()),
        "pack": pack_candidates(objects, live, ranks, cold_before_ms, budget),
        "repack": repack_candidates(packed, live, least_bytes),
    }
    return found | {"status": sweep_status(**found)}
