"""The read interface: health, pages of a session's calls, and one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelume.operators import paging, rollup, steps

VERSION = "0.1.0"


def health() -> dict[str, object]:
    return {"ok": True, "name": "tracelume", "version": VERSION}


def list_calls(calls: DataFrame, session_id: object, limit: object = None, offset: object = None, model: str | None = None, cap: int = 20_000) -> dict[str, DataFrame | int]:
    """A newest-first page with steps, the number of calls it is from, and the session's tallies over all its calls."""
    limit, offset = paging.limits(limit, offset, cap)
    own = steps.with_steps(calls.where(F.col("session_id") == F.lit(session_id)))
    chosen = own.where(F.col("model") == model) if model else own
    out = {"calls": paging.page(own, limit, offset, model), "total": chosen.count(), "models": rollup.model_tally(own).orderBy("first_pos")}
    return out | ({"footprint": rollup.footprint(own)} if "line_bytes" in own.columns else {})


def get_call(calls: DataFrame, session_id: object, call_id: object) -> DataFrame:
    """The first call of that id in the session, or no row."""
    return calls.where((F.col("session_id") == F.lit(session_id)) & (F.col("id") == F.lit(call_id))).orderBy("pos").limit(1)


def get_calls(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for many: the first call of each ``wanted(session_id, id)`` that there is."""
    key = ["session_id", "id"]
    first = Window.partitionBy(*key).orderBy("pos")
    found = calls.join(wanted.select(*key), key, "left_semi").withColumn("_n", F.row_number().over(first))
    return found.where("_n = 1").drop("_n")
