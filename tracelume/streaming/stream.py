"""Streams: chunks folded into records, retries numbered as calls arrive, pages refreshed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelume import schema
from tracelume.functions import expr
from tracelume.operators.steps import RETRY_MS, Tracker
from tracelume.streaming import splice

#: Chunks: what a call sends, in order of ``seq``; block, usage, finish and failure as JSON where the kind has them.
CHUNKS = "call string, seq bigint, at bigint, kind string, block string, usage string, finish_kind string, failure string"
RECORD = "call string, first_at bigint, ended_at bigint, chunk_count bigint, blocks array<string>, usage string, finish_kind string, failure string, status string"
ABORTED = json.dumps({"message": "stream closed before finish", "code": "ABORTED"}, separators=(",", ":"))


def _in_order(batches: Iterator[pd.DataFrame], by: str, *names: str) -> list[tuple]:
    """``by`` and the named columns of all rows, in order of ``by``: a key has few rows, for which frames of its own would cost more than the fold."""
    return sorted((row for b in batches for row in zip(*(b[c].tolist() for c in (by, *names)))), key=lambda row: row[0])


def status_of(finish: Column, ended: Column) -> Column:
    """ok unless the finish says otherwise; a stream torn down before its finish is aborted."""
    return F.when(finish.isin("error", "aborted"), finish).when(finish.isNotNull() | ended, "ok").otherwise("aborted")


def redacted(failure: Column) -> Column:
    """A failure's JSON with its message redacted and capped; what is no such JSON is redacted as a text. No credential of a provider's error text is stored."""
    f = F.from_json(failure, schema.FAILURE)
    known = F.struct(expr.redact(f["message"]).alias("message"), f["code"].alias("code"), f["status"].alias("status"), f["requestId"].alias("requestId"))
    return F.when(f["message"].isNotNull(), F.to_json(known)).otherwise(expr.redact(failure))


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """One record per call, from a batch: finished blocks in order, the last usage and finish, first chunk's time, all chunks counted.

    A chunk of kind ``end`` closes a stream and is not counted; with it and without a
    finish, the call stopped as usual.
    """
    chunks = chunks.withColumn("failure", redacted(F.col("failure")))
    real = F.col("kind") != "end"
    blocks = F.array_sort(F.collect_list(F.when(F.col("kind") == "block-end", F.struct("seq", "block"))))
    last = lambda c, k: F.max_by(F.when(F.col("kind") == k, F.col(c)), F.when(F.col("kind") == k, F.col("seq")))
    out = chunks.groupBy("call").agg(
        F.min(F.when(real, F.col("at"))).alias("first_at"),
        F.max("at").alias("ended_at"),
        F.count_if(real).alias("chunk_count"),
        blocks.alias("b"),
        last("usage", "usage").alias("usage"),
        last("finish_kind", "finish").alias("f"),
        last("failure", "finish").alias("failure"),
        F.max(~real).alias("ended"),
    )
    kind = F.when(F.col("f").isNotNull(), F.col("f")).when(F.col("ended"), "stop").otherwise("aborted")
    failure = F.when(F.col("f").isNull() & ~F.col("ended"), F.lit(ABORTED)).otherwise(F.col("failure"))
    return out.select("call", "first_at", "ended_at", "chunk_count", F.transform("b", lambda x: x["block"]).alias("blocks"), "usage", kind.alias("finish_kind"), failure.alias("failure"), status_of(F.col("f"), F.col("ended")).alias("status"))


class _Fold(StatefulProcessor):
    """A call's blocks as a list, one row each, and a head; a timer tells of a stream that fell silent."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "first_at bigint, ended_at bigint, chunk_count bigint, usage string, finish_kind string, failure string")
        self.blocks = handle.getListState("blocks", "seq bigint, block string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, ended, count, usage, kind, failure = self.head.get() or (None, 0, 0, None, None, None)
        done, fresh = False, []
        for seq, at, what, block, used, finish, failed in _in_order(rows, "seq", "at", "kind", "block", "usage", "finish_kind", "failure"):
            ended = max(ended, at)
            if what == "end":
                done = True
                continue
            first, count = int(at) if first is None else min(first, int(at)), count + 1
            if what == "block-end":
                fresh.append((int(seq), block if isinstance(block, str) else None))
            elif what == "usage":
                usage = used if isinstance(used, str) else None
            elif what == "finish":
                kind, failure = finish, failed if isinstance(failed, str) else None
        for timer in list(self.handle.listTimers()) if self.idle_ms is not None else ():
            self.handle.deleteTimer(timer)
        if done:
            yield self._record(key, first, ended, count, usage, kind or "stop", failure, fresh)
            return
        if fresh:
            self.blocks.appendList(fresh)
        self.head.update((first, int(ended), count, usage, kind, failure))
        if self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            first, ended, count, usage, kind, failure = self.head.get()
            yield self._record(key, first, ended, count, usage, kind or "aborted", failure if kind else ABORTED, [])

    def _record(self, key, first, ended, count, usage, kind, failure, fresh) -> pd.DataFrame:
        held = sorted([*(tuple(b) for b in self.blocks.get()), *fresh])
        self.head.clear()
        self.blocks.clear()
        row = [key[0], first, int(ended), count, [b for _, b in held], usage, kind, failure, kind if kind in ("error", "aborted") else "ok"]
        return pd.DataFrame({c.split()[0]: pd.array([x], "Int64") if c == "first_at bigint" else [x] for c, x in zip(RECORD.split(", "), row)})

    def close(self) -> None:
        pass


def _with_state(grouped, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    """Several kinds of state need the RocksDB store, which a session names before its query starts."""
    grouped._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return grouped.transformWithStateInPandas(processor, schema, "append", time)


def stream_records(chunks: DataFrame, idle_ms: int | None = 60_000) -> DataFrame:
    """The same for a stream: a record when its end arrives, or, torn down, after ``idle_ms`` of silence.

    A query that waits for silence runs until it is stopped; with None calls without an end stay open, and a
    query over what is there now ends. A batch adds its blocks to the call's state and reads none of those before; they are read once, for the record.
    """
    return _with_state(chunks.withColumn("failure", redacted(F.col("failure"))).groupBy("call"), _Fold(idle_ms), RECORD, "None" if idle_ms is None else "ProcessingTime")


class _Bounded(StatefulProcessor):
    """Attempts of the keys of one shard, in a map of at most ``most`` keys when a call begins."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "session_id bigint, provider string", "hash string, attempt int, began bigint, ok boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {tuple(k): tuple(v) for k, v in self.keys.iterator()}
        before, out = dict(known), []
        for c in pd.concat(list(rows)).sort_values("pos").itertuples():
            for k in [k for k, v in known.items() if c.started_at - v[2] > self.window_ms]:
                del known[k]
            while len(known) > self.most:
                del known[min(known, key=lambda k: known[k][2])]
            k, tracker = (int(c.session_id), c.provider), Tracker(self.window_ms)
            if k in known:
                h, attempt, began, ok = known[k]
                tracker.state = (h, attempt, began, True, ok)
            attempt = tracker.begin(c.request_hash, int(c.started_at))
            # the youngest stands last, so of equal starts the one that came first goes first
            known.pop(k, None)
            known[k] = (c.request_hash, attempt, int(c.started_at), c.status == "ok")
            out.append((*k, int(c.id), attempt))
        for k in before.keys() - known.keys():
            self.keys.removeKey(k)
        for k, v in known.items():
            if before.get(k) != v:
                self.keys.updateValue(k, v)
        yield pd.DataFrame(out, columns=["session_id", "provider", "id", "attempt"])

    def close(self) -> None:
        pass


#: Keys whose attempts one process remembers.
KEYS = 1024


def stream_attempts_bounded(calls: DataFrame, window_ms: int = RETRY_MS, most: int = KEYS, shards: int = 1) -> DataFrame:
    """``attempt`` of settled calls as one recorder numbers them, which remembers ``most`` keys: beyond that the oldest start is forgotten.

    ``shards`` recorders share sessions by hash, each with a memory of its own; one is one recorder. Its state
    is bounded whatever passes through.
    """
    shard = F.pmod(F.xxhash64("session_id"), F.lit(shards)).alias("shard")
    rows = calls.select(shard, "session_id", "provider", "id", "pos", "request_hash", "status", "started_at")
    return _with_state(rows.groupBy("shard"), _Bounded(window_ms, most), ATTEMPTS, "None")


ATTEMPTS = "session_id bigint, provider string, id bigint, attempt int"


def stream_attempts(calls: DataFrame, window_ms: int = RETRY_MS, late_ms: int = 86_400_000) -> DataFrame:
    """``attempt`` of each call of a stream of settled calls, per session and provider.

    Calls of one micro-batch are taken in order of ``pos``; batches must arrive in that order.
    Time is the calls' own, ``started_at``: a key whose last call began more than ``window_ms`` before
    the watermark can have no retry any more, and its state goes. So state is bounded by the keys
    active within the window and ``late_ms``, whatever has passed through. A call that arrives
    when the newest of earlier batches began over ``late_ms`` after it is not numbered.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker, out = Tracker(window_ms), []
        if state.exists:
            h, attempt, began, ok = state.get
            tracker.state = (h, attempt, began, True, ok)
        for _, call, request_hash, started_at, status in _in_order(batches, "pos", "id", "request_hash", "started_at", "status"):
            out.append((*key, call, tracker.begin(request_hash, started_at)))
            tracker.settle(status == "ok")
        h, attempt, began, _, ok = tracker.state
        state.update((h, attempt, int(began), bool(ok)))
        # one beyond the window, as a retry at its very end still counts; never behind the watermark
        state.setTimeoutTimestamp(max(int(began) + window_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["session_id", "provider", "id", "attempt"])

    # what else a call has would be handed over key by key
    calls = calls.select("session_id", "provider", "id", "pos", "request_hash", "status", "started_at")
    timed = calls.withColumn("at", F.timestamp_millis("started_at")).withWatermark("at", f"{max(late_ms, window_ms)} milliseconds")
    return timed.groupBy("session_id", "provider").applyInPandasWithState(run, ATTEMPTS, "hash string, attempt int, began bigint, ok boolean", "append", GroupStateTimeout.EventTimeTimeout)


def refresh(calls: DataFrame, path: str, checkpoint: str, seconds: float | None = 3) -> StreamingQuery:
    """Keep the table at ``path`` (see :mod:`tracelume.streaming.splice`) up to a stream of calls, every few seconds, or once with None."""
    writer = calls.writeStream.foreachBatch(splice.sink(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
