"""Pages of the newest calls, and reconciling them."""

from __future__ import annotations

from math import isfinite, trunc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 50


def limits(limit: object = None, offset: object = None, cap: int = 20_000) -> tuple[int, int]:
    """Arguments of a page as numbers: a limit from 1 to the cap, an offset from 0; what is no number is the default, an empty text is zero."""

    def number(v: object, default: int) -> int:
        if v is None:
            return default
        try:
            x = float(v) if str(v).strip() else 0.0
        except ValueError:
            return default
        return trunc(x) if isfinite(x) else default

    return max(1, min(number(limit, DEFAULT_LIMIT), max(cap, DEFAULT_LIMIT))), max(0, number(offset, 0))


def page(calls: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, model: str | None = None) -> DataFrame:
    """Newest first; the model filter, by equality, comes before paging. An empty model is no filter."""
    if model:
        calls = calls.where(F.col("model") == model)
    return calls.orderBy(F.desc("pos")).offset(offset).limit(limit)


def reconcile(loaded: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union by id; of rows of one id the one with the greatest pos stays, a fresh one on ties."""
    both = loaded.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    row = F.max_by(F.struct(*[c for c in both.columns if c != "_fresh"]), F.struct("pos", "_fresh")).alias("r")
    return both.groupBy(F.col("id").alias("_id")).agg(row).select("r.*")
