"""Order-dependent numbering within a session. Order is ``pos``, the place in the log, never the time.

Windows are partitioned by session (and purpose or key): a session is bounded by the
log's cap on calls, so partitions stay small however large the log is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRY_MS = 120_000


def with_steps(calls: DataFrame) -> DataFrame:
    """``step``: ordinary calls are numbered; a first attempt, or the first ordinary call, opens a step. Others get null."""
    by = Window.partitionBy("session_id").orderBy("pos")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    ordinary = F.col("purpose").isNull()
    rank = F.sum(ordinary.cast("long")).over(so_far)
    out = calls.withColumn("_rank", rank)
    opens = ordinary & ((F.col("attempt") == 1) | (F.col("_rank") == 1))
    return out.withColumn("step", F.when(ordinary, F.sum(opens.cast("long")).over(so_far))).drop("_rank")


def with_predecessor(calls: DataFrame) -> DataFrame:
    """``prev_id``: the latest earlier ok call of the same purpose with another request hash.

    The last ok call answers directly if its hash differs. Otherwise the answer is what
    stood before the current run of equal hashes, carried forward from its start.
    """
    group = [F.col("session_id"), F.coalesce("purpose", F.lit(""))]
    by = Window.partitionBy(*group).orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.when(F.col("status") == "ok", F.struct("id", "request_hash"))
    out = calls.withColumn("_ok", ok).withColumn("_last", F.last("_ok", True).over(before))
    # at an ok call that follows an ok call of another hash, the latter is what all of the new run looks back to
    turn = F.when((F.col("status") == "ok") & ((F.col("_last.request_hash") != F.col("request_hash")) | F.col("_last").isNull()), F.struct(F.col("_last.id").alias("id")))
    out = out.withColumn("_turn", turn).withColumn("_kept", F.last("_turn", True).over(before))
    prev = F.when(F.col("_last.request_hash") != F.col("request_hash"), F.col("_last.id")).otherwise(F.col("_kept.id"))
    return out.withColumn("prev_id", prev).drop("_ok", "_last", "_turn", "_kept")


def with_attempts(calls: DataFrame, window_ms: int = RETRY_MS) -> DataFrame:
    """``attempt`` where calls of a session and provider do not overlap.

    A call continues the one before it if that has its hash, is settled, failed, and began
    at most ``window_ms`` earlier.
    """
    by = Window.partitionBy("session_id", "provider").orderBy("pos")
    prior = F.lag(F.struct("request_hash", "status", "started_at")).over(by)
    out = calls.withColumn("_p", prior)
    links = (F.col("_p.request_hash") == F.col("request_hash")) & ~F.col("_p.status").isin("ok", "open") & (F.col("started_at") - F.col("_p.started_at") <= window_ms)
    out = out.withColumn("_run", F.sum((~F.coalesce(links, F.lit(False))).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    again = Window.partitionBy("session_id", "provider", "_run").orderBy("pos")
    return out.withColumn("attempt", F.row_number().over(again)).drop("_p", "_run")


class Tracker:
    """Attempts of one key. A settlement settles whatever attempt is current, even another's."""

    def __init__(self, window_ms: int = RETRY_MS):
        self.window = window_ms
        self.state: tuple | None = None  # hash, attempt, began, settled, ok

    def begin(self, request_hash: str, at: int) -> int:
        s = self.state
        again = s is not None and s[0] == request_hash and s[3] and not s[4] and at - s[2] <= self.window
        attempt = s[1] + 1 if again else 1
        self.state = (request_hash, attempt, at, False, False)
        return attempt

    def settle(self, ok: bool) -> None:
        if self.state is not None:
            self.state = (*self.state[:3], True, ok)


def with_attempts_overlapping(calls: DataFrame, window_ms: int = RETRY_MS) -> DataFrame:
    """``attempt`` where calls overlap: begins and settlements of a key are replayed in time order.

    A begin precedes a settlement of the same millisecond, and positions break ties.
    """
    key = ["session_id", "provider"]
    begins = calls.select(*key, "pos", F.col("started_at").alias("at"), F.lit(0).alias("kind"), "request_hash", F.lit(None).cast("boolean").alias("ok"))
    ends = calls.where("duration_ms is not null and status <> 'open'").select(
        *key, "pos", (F.col("started_at") + F.col("duration_ms")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("request_hash"), (F.col("status") == "ok").alias("ok")
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = Tracker(window_ms), []
        for e in pdf.sort_values(["at", "kind", "pos"]).itertuples():
            if e.kind == 0:
                out.append((e.session_id, e.pos, tracker.begin(e.request_hash, e.at)))
            else:
                tracker.settle(bool(e.ok))
        return pd.DataFrame(out, columns=["session_id", "pos", "attempt"])

    types = dict(calls.dtypes)
    found = begins.union(ends).groupBy(*key).applyInPandas(fold, f"session_id {types['session_id']}, pos bigint, attempt int")
    return calls.drop("attempt").join(found, ["session_id", "pos"])


