"""Ordered operators against folds, trees, sources, wire formats, streams."""

import hashlib
import json
import random
import time

import pytest

from tracelume.operators import chart, maintain, objects, paging, rollup, steps, tree, wire
from tracelume.sources import log
from tracelume.streaming import stream

CALL = "session_id string, id string, pos long, purpose string, provider string, model string, request_hash string, attempt int, started_at long, duration_ms long, ttfb_ms long, status string, input_tokens long, cache_read long, cache_write long, output_tokens long"


def random_calls(seed, n=160):
    r, out, at = random.Random(seed), [], 0
    for k in range(n):
        at += r.choice((0, 1000, 90_000))
        s = r.choice("ab")
        out.append((s, f"{s}{k}", k, r.choice((None, None, None, "compaction")), "p", r.choice("xy"), r.choice("hij"), r.choice((1, 1, 2)), at, r.choice((10, 1500)), 5, r.choice(("ok", "ok", "error", "aborted")), 10, r.choice((None, 5)), 0, r.choice((None, 7))))
    return out


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame(random_calls(1) + [], CALL).repartition(4)


def rows():
    return [dict(zip([c.split()[0] for c in CALL.split(", ")], r)) for r in random_calls(1)]


def test_steps_and_predecessors_match_folds(calls):
    step, prev, seen = {}, {}, {}
    for c in rows():
        s = seen.setdefault(c["session_id"], {"n": 0, "any": False})
        if c["purpose"] is None:
            s["n"] += c["attempt"] == 1 or not s["any"]
            s["any"] = True
            step[c["id"]] = s["n"]
        before = [p for p in rows() if p["session_id"] == c["session_id"] and p["purpose"] == c["purpose"] and p["pos"] < c["pos"] and p["status"] == "ok" and p["request_hash"] != c["request_hash"]]
        prev[c["id"]] = before[-1]["id"] if before else None
    assert {r.id: r.step for r in steps.with_steps(calls).collect() if r.step is not None} == step
    assert {r.id: r.prev_id for r in steps.with_predecessor(calls).collect()} == prev


def test_attempts_in_sequence_and_overlapping(spark, calls):
    want, t = {}, {}
    for c in rows():
        tracker = t.setdefault(c["session_id"], steps.Tracker())
        want[c["id"]] = tracker.begin(c["request_hash"], c["started_at"])
        tracker.settle(c["status"] == "ok")
    assert {r.id: r.attempt for r in steps.with_attempts(calls.drop("attempt")).collect()} == want
    # an older call settling late settles the newer one
    both = [("s", "1", 0, "p", "h", 0, 50, "error"), ("s", "2", 1, "p", "h", 10, 90, "ok"), ("s", "3", 2, "p", "h", 60, 5, "error"), ("s", "4", 3, "p", "h", 95, 5, "ok")]
    df = spark.createDataFrame(both, "session_id string, id string, pos long, provider string, request_hash string, started_at long, duration_ms long, status string")
    assert {r.id: r.attempt for r in steps.with_attempts_overlapping(df).collect()} == {"1": 1, "2": 1, "3": 2, "4": 3}


def test_collapse_prefers_later_attempts_and_usage(spark):
    base = ("s", None, "p", "m", "h")
    made = [("a", 1, 1, 7), ("b", 2, 2, None), ("c", 3, 2, 3), ("d", 4, 1, 9)]
    df = spark.createDataFrame([("s", i, p, None, "p", "m", "h", a, p, 10, 5, "ok", 1, 1, 1, o) for i, p, a, o in made], CALL)
    from pyspark.sql import functions as F

    assert chart.collapse_steps(df.withColumn("step", F.lit(1))).first().id == "c" and base


def test_summary_and_buckets(spark):
    minute = 60_000
    u = [("s", "1", 0, None, "p", "m", "h", 1, 1 * minute, 1, 1, "ok", 100, 900, 5, 20), ("s", "2", 1, None, "p", "m", "h", 2, 4 * minute, 1, 1, "error", 50, None, None, 10), ("s", "3", 2, "x", "p", "n", "h", 1, 21 * minute, 1, 1, "aborted", None, None, None, None)]
    df = spark.createDataFrame(u, CALL)
    r = rollup.session_summary(df).first()
    assert (r.n_calls, r.errors, r.aborts, r.retried, r.billed, r.input, r.cache_read, r.cache_write, r.output) == (3, 1, 1, 1, 1055, 150, 900, 5, 30)
    b = rollup.token_buckets(df, 5).orderBy("bucket").collect()
    assert [(x.input_tokens, x.cache_read, x.cache_write, x.output_tokens, x.call_id) for x in b] == [(150, 900, 5, 30, "1"), (0, 0, 0, 0, ""), (0, 0, 0, 0, ""), (0, 0, 0, 0, ""), (0, 0, 0, 0, "3")]
    assert [(x.model, x.n_calls) for x in rollup.model_tally(df).orderBy("first_pos").collect()] == [("m", 2), ("n", 1)]


def test_windows_are_not_shuffled(spark):
    """Windows without calls are made after the calls' own shuffle, so what is shuffled does not grow with them."""
    cols = "session_id long, pos long, id long, started_at long, cache_read long, input_tokens long, cache_write long, output_tokens long"
    rows = [(1, 0, 7, 300_000, 1, 2, 3, 4), (1, 1, 8, 10, 1, None, 3, 4), (1, 2, 9, 86_400_000, 0, 5, 0, 0), (2, 0, 1, 600_000, 0, 1, 0, 0), (2, 1, 2, None, 9, 9, 9, 9), (3, 0, 3, None, 9, 9, 9, 9), (None, 0, 4, 0, 9, 9, 9, 9)]
    out = rollup.token_buckets(spark.createDataFrame(rows, cols), 5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.session_id, r.bucket): tuple(r)[2:] for r in out.collect()}
    assert len(got) == out.count() == 289 + 1 + 1
    assert {k: v for k, v in got.items() if v != (0, 0, 0, 0, "")} == {(1, 0): (1, 0, 3, 4, "8"), (1, 300_000): (1, 2, 3, 4, "7"), (1, 86_400_000): (0, 5, 0, 0, "9"), (2, 600_000): (0, 1, 0, 0, "1")}
    assert got[None, 0] == (0, 0, 0, 0, "")


def test_stack_and_runs(spark):
    p = spark.createDataFrame([("s", 0, 1, k, v) for k, v in (("cacheRead", 900.0), ("in", None), ("cacheWrite", 5.0), ("out", 10.0))], "session_id string, pos long, x long, series string, y double")
    assert {r.series: r.top for r in chart.stacked(p).collect()} == {"cacheRead": 900, "in": None, "cacheWrite": 905, "out": 915}
    assert {r.series: r.top for r in chart.stacked(p, hidden=("cacheRead",)).collect()} == {"in": None, "cacheWrite": 5, "out": 15}
    q = spark.createDataFrame([("s", k, k, "a", v) for k, v in enumerate((None, 1.0, 2.0, float("nan"), None, 3.0, float("inf")))], "session_id string, pos long, x long, series string, y double")
    assert [(r.pos, r.run) for r in chart.runs(q).orderBy("pos").collect()] == [(1, 1), (2, 1), (5, 2)]
    assert chart.extent(q).first() == (1.0, 3.0)


def test_reconcile(spark):
    a = spark.createDataFrame([("1", 1, "open"), ("2", 2, "ok")], "id string, pos long, status string")
    b = spark.createDataFrame([("1", 1, "ok"), ("3", 3, "ok")], "id string, pos long, status string")
    assert sorted(map(tuple, paging.reconcile(a, b).collect())) == [("1", 1, "ok"), ("2", 2, "ok"), ("3", 3, "ok")]


def test_nodes_match_a_fold(spark):
    r, lists, want = random.Random(4), [], []
    for s in "ab":
        cur, depth, last = [], 0, None
        for k in range(90):
            cur = r.choice((cur, cur + [f"h{k}"], cur + [f"h{k}", "z"], cur + ["q"], [f"n{k}"]))
            grows = last is not None and cur[: len(last)] == last
            kind = "reuse" if grows and cur == last else "delta" if grows and depth < 4 else "keyframe"
            depth = depth if kind == "reuse" else depth + 1 if kind == "delta" else 0
            lists.append((s, k, cur))
            want.append((s, k, kind, depth))
            last = cur
    got = tree.choose_nodes(spark.createDataFrame(lists, "session_id string, pos long, entries array<string>"), 4)
    assert sorted((x.session_id, x.pos, x.kind, x.depth) for x in got.collect()) == sorted(want)


def test_resolution_is_all_or_nothing(spark):
    nodes = [("k", None, ["a"]), ("d", "k", ["b"]), ("x", "gone", ["c"]), ("y", "z", ["e"]), ("z", "y", ["f"])] + [(f"c{k}", f"c{k - 1}" if k else None, [str(k)]) for k in range(65)]
    n = spark.createDataFrame(nodes, "hash string, parent string, entries array<string>")
    roots = spark.createDataFrame([(h, h) for h in ("d", "x", "y", "c63", "c64", "none")], "call string, hash string")
    got = {r.call: r.entries for r in tree.resolve(roots, n).collect()}
    assert got == {"d": ["a", "b"], "x": None, "y": None, "c63": [str(k) for k in range(64)], "c64": None, "none": None}
    assert {r.hash for r in tree.reachable(spark.createDataFrame([("y",), ("d",)], "hash string"), n).collect()} == {"y", "z", "d", "k"}


def test_node_json(spark):
    from pyspark.sql import functions as F

    h = "a" * 64
    texts = [f'{{"t":3,"p":"{h}","e":[{{"k":"m","h":"{h}"}}]}}', '{"t":3,"e":[{"k":"q","h":"' + h + '"}]}', '{"t":2,"e":[]}', "x", '{"t":3,"p":"zz","e":[]}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tree.decode(F.col("t"))).collect()]
    assert got[0].p == h and got[1:] == [None] * 4
    back = spark.range(1).select(tree.encode(F.array(F.struct(F.lit("m").alias("k"), F.lit(h).alias("h"))), F.lit(None).cast("string"))).first()[0]
    assert back == f'{{"t":3,"e":[{{"k":"m","h":"{h}"}}]}}'


def test_pieces(spark):
    c = spark.createDataFrame([(1, 1, "sys", None, ["m1"]), (2, 2, "sys", "[]", ["m1", "m2", "m1"])], "call long, at long, system string, tools string, messages array<string>")
    p = objects.request_pieces(c)
    assert [(r.call, r.pos, r.k, r.body) for r in p.orderBy("call", "pos").collect()] == [(1, 0, "s", "sys"), (1, 1, "m", "m1"), (2, 0, "s", "sys"), (2, 1, "t", "[]"), (2, 2, "m", "m1"), (2, 3, "m", "m2"), (2, 4, "m", "m1")]
    stored = objects.put(p)
    assert stored.count() == 4 and objects.put(p, stored).count() == 0 and objects.verified(stored).count() == 4
    assert {r.call: r.bytes for r in objects.marginal_bytes(p).collect()} == {1: 5, 2: 4}
    got = {r.call: r.bodies for r in objects.reassemble(p.select("call", "pos", "hash"), stored.where("body <> 'm2'")).collect()}
    assert got[1] == ["sys", "m1"] and got[2][3] == '{"$unavailable":"' + hashlib.sha256(b"m2").hexdigest() + '"}'
    order = objects.packing_order(spark.createDataFrame([(2, 0, ["c", "a"]), (1, 1, ["b", "a"]), (1, 0, ["a"])], "at long, seq long, hashes array<string>"))
    assert [r.hash for r in order.orderBy("rank").collect()] == ["a", "b", "c"]


def test_maintenance(spark):
    o = spark.createDataFrame([("a", 10, 0), ("b", 10, 0), ("c", 10, 9_000_000), ("d", 500, 0)], "hash string, bytes long, mtime_ms long")
    live = spark.createDataFrame([("a",), ("d",)], "hash string")
    assert [r.hash for r in maintain.garbage(o, live, 9_000_000).collect()] == ["b"] and maintain.garbage(o, live, 9_000_000, complete=False).count() == 0
    ranks = spark.createDataFrame([("d", 1)], "hash string, rank long")
    assert [r.hash for r in maintain.pack_candidates(o, live, ranks, 1, 100).collect()] == ["d"]  # one at least
    assert sorted(r.hash for r in maintain.pack_candidates(o, live, ranks, 1, 501).collect()) == ["a", "d"]
    lines = spark.createDataFrame([("s", k, b) for k, b in enumerate((5, 5, 100, 5, 5))], "session_id string, pos long, bytes long")
    assert sorted(r.pos for r in maintain.trim_bytes(lines, 20).collect()) == [3, 4] and sorted(r.pos for r in maintain.trim_count(lines, 2).collect()) == [3, 4]
    assert [tuple(r) for r in maintain.sweep_status(trimmed=lines, live=live).collect()] == [("trimmed", 5, 120), ("live", 2, 0)]


V1 = {"schema": 1, "id": "1", "sessionId": "s", "provider": "p", "model": "m", "requestHash": "h", "attempt": 1, "timing": {"startedAt": 10, "firstChunkAt": 15, "endedAt": 40}, "status": "ok"}
V1 |= {"request": {"system": "sys😀", "messages": [{"role": "user", "content": [{"type": "text", "text": "héy"}, {"type": "image"}]}], "tools": [{"name": "t", "description": "d", "parameters": {}}]}}
V1 |= {"response": {"blocks": [{"type": "tool-call", "id": "x", "name": "run_code", "arguments": '{"code":"tools.a();tools.a()"}'}], "usage": {"inputTokens": 1, "outputTokens": 2}, "finish": {"kind": "stop"}, "chunkCount": 3}}
HEAD = {k: V1[k] for k in ("id", "sessionId", "provider", "model", "requestHash", "attempt", "timing", "status")}
SUM = {"messageCount": 1, "requestChars": 8, "toolCalls": 2, "usage": {"inputTokens": 1, "outputTokens": 2}, "finishKind": "stop"}


def dumps(x):
    return json.dumps(x, separators=(",", ":"))


def test_log_versions(spark, tmp_path):
    lines = [dumps(V1), dumps({"v": 2, **HEAD, "id": "2", "sum": SUM, "refs": [{"k": "m", "h": "a" * 64, "z": 7}]}), dumps({"v": 3, **HEAD, "id": "3", "sum": SUM, "tree": "b" * 64, "zn": 9})]
    lines += ["nope", "", "[1]", dumps({"v": 9}), dumps({"schema": 2, "id": "x"}), dumps({"v": 3, **HEAD, "sum": SUM})]
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n" + dumps(V1))
    (tmp_path / "empty.jsonl").write_text("")
    read = log.read_lines(spark, str(tmp_path))
    found = {r.id: r for r in log.calls(read).collect()}
    assert set(found) == {"1", "2", "3"} and [found[k].version for k in "123"] == [1, 2, 3]
    assert (found["1"].request_chars, found["1"].tool_calls, found["1"].message_count, found["1"].duration_ms, found["1"].ttfb_ms) == (8, 2, 1, 30, 5)
    assert [(x["name"], x["count"]) for x in found["1"].called_tools] == [("a", 2)] and found["1"].tool_names == ["t"]
    assert [found[k].object_bytes for k in "123"] == [0, 7, 9] and found["2"].cache_read is None
    assert {r.hash: r.is_tree for r in log.referenced(read).collect()} == {"a" * 64: False, "b" * 64: True}
    assert [r.pos for r in log.tail(read, spark.createDataFrame([("s", 7)], "session_id string, next_pos long")).collect()] == [7, 8]
    assert log.legacy(read).count() == 7


def test_objects_and_packs(spark, tmp_path):
    bodies = [b"x" * 500, b"", "é".encode()]
    named = [(hashlib.sha256(b).hexdigest(), b) for b in bodies]
    for h, b in named:
        (tmp_path / h).write_bytes(log.put_frame(b))
    (tmp_path / ("f" * 64)).write_bytes(log.put_frame(b"other"))
    assert {(r.hash, bytes(r.body)) for r in log.read_objects(spark, str(tmp_path)).collect()} == set(named)
    whole = b"DRP1" + bytes(12) + log.block(named[:2]) + log.block(named[2:])
    packs = tmp_path / "packs"
    packs.mkdir()
    (packs / "a.pack").write_bytes(whole)
    (packs / "b.pack").write_bytes(whole[:-1])
    got = [(r.pack[-6:], r.hash) for r in log.read_packs(spark, str(packs)).collect()]
    assert sorted(got) == sorted([("a.pack", h) for h, _ in named] + [("b.pack", h) for h, _ in named[:2]])
    assert log.frame(b"DRL1\x01broken") is None and log.inflate(log.put_frame(b"0" * 4000)[5:], 100) is None
    import zstandard

    payload = zstandard.ZstdCompressor(level=12).compress(b"x" * 500)
    z = log.block(named[:1])
    z = len(payload).to_bytes(4, "big") + b"\x02" + z[5:47] + payload
    assert list(log.blocks(z, 0)) == named[:1]


def test_wire_shapes():
    r = V1 | {"reasoningEffort": "high", "request": V1["request"] | {"temperature": 0.5, "messages": [{"id": "1", "role": "user", "content": [{"type": "text", "text": "q"}]}, {"id": "2", "role": "assistant", "content": [{"type": "reasoning", "text": "r"}, {"type": "tool-call", "id": "c", "name": "f", "arguments": {"a": 1}}]}, {"id": "3", "role": "user", "content": [{"type": "tool-result", "toolCallId": "c", "content": [{"type": "text", "text": "ok"}], "isError": True}, {"type": "odd"}]}]}}
    a = wire.render(r, "anthropic-messages", "request")["body"]
    assert a["thinking"]["type"] == "adaptive" and "temperature" not in a and len(a["_note"]) == 3 and a["messages"][1]["content"][1]["input"] == {"a": 1}
    assert a["messages"][2]["content"][1] == {"type": "opaque", "blockType": "odd"} and a["tools"][0]["input_schema"] == {}
    c = wire.render(r, "openai-completions", "request")["body"]
    assert [m["role"] for m in c["messages"]] == ["system", "user", "assistant", "user", "tool"] and c["messages"][2]["tool_calls"][0]["function"]["arguments"] == "[object Object]"
    assert c["messages"][2]["content"] is None and c["messages"][4]["_isError"] is True and c["reasoning_effort"] == "high"
    o = wire.render(r, "openai-responses", "request")["body"]
    assert [x["type"] for x in o["input"]] == ["message", "message", "reasoning", "function_call", "function_call_output", "message"] and o["input"][0]["role"] == "developer" and o["prompt_cache_key"] == "s"
    bad = V1 | {"response": V1["response"] | {"finish": {"kind": "error", "failure": {"message": "m", "code": "c", "status": 500}}, "usage": {"inputTokens": 1, "outputTokens": 2, "cacheReadTokens": 3, "cacheWriteTokens": 4, "reasoningTokens": 1}}}
    x = wire.render(bad, "openai-completions", "response")
    assert x["choices"][0]["finish_reason"] is None and x["_error"]["status"] == 500 and x["usage"]["prompt_tokens"] == 8 and x["usage"]["total_tokens"] == 10 and x["choices"][0]["message"]["tool_calls"][0]["index"] == 0
    y = wire.render(bad, "anthropic-messages", "response")
    assert y["stop_reason"] is None and y["usage"] == {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4} and y["content"][0]["input"] == {"code": "tools.a();tools.a()"}
    z = wire.render(bad, "openai-responses", "response")
    assert z["status"] == "failed" and z["usage"]["total_tokens"] == 10 and z["error"] == {"message": "m", "code": "c"}
    prior = r | {"id": "0", "requestHash": "g", "request": r["request"] | {"messages": r["request"]["messages"][:1]}}
    assert wire.chain(wire.Record(r), wire.Record(prior)) == {"chained": True, "sent": 2, "skipped": 3, "previous": "reqlog_g_1"}
    assert not wire.chain(wire.Record(r), wire.Record(prior | {"status": "error"}))["chained"]
    assert wire.render(V1 | {"request": {"messages": [{"role": "user", "content": "s"}, {"role": "user", "content": None}]}}, "anthropic-messages", "request")["body"]["messages"][0]["content"][1]["text"] == "s"
    assert [wire.detect(*x) for x in (("x", "Claude-3"), ("azure-Responses", "m"), ("openai", "gpt-4"))] == ["anthropic-messages", "openai-responses", "openai-completions"]


def test_chunks(spark, tmp_path):
    chunk = lambda call, seq, kind, **x: (call, seq, 100 + seq, kind, x.get("block"), x.get("usage"), x.get("finish"), x.get("failure"))
    data = [chunk("a", 0, "block-start"), chunk("a", 1, "text-delta"), chunk("a", 2, "block-end", block="B1"), chunk("a", 3, "usage", usage="U"), chunk("a", 4, "block-end", block="B2"), chunk("a", 5, "finish", finish="tool-calls"), chunk("a", 6, "end")]
    data += [chunk("b", 0, "text-delta"), chunk("b", 1, "end"), chunk("c", 0, "text-delta"), chunk("d", 0, "finish", finish="error", failure="F"), chunk("d", 1, "end"), chunk("e", 0, "end")]
    df = spark.createDataFrame(data, stream.CHUNKS)
    got = {r.call: r for r in stream.fold_chunks(df).collect()}
    a = got["a"]
    assert (a.first_at, a.ended_at, a.chunk_count, a.blocks, a.usage, a.finish_kind, a.status) == (100, 106, 6, ["B1", "B2"], "U", "tool-calls", "ok")
    assert (got["b"].finish_kind, got["b"].status) == ("stop", "ok") and (got["d"].status, got["d"].failure) == ("error", "F") and got["e"].first_at is None
    assert got["c"].status == "aborted" and "ABORTED" in got["c"].failure
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream.stream_records(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 1000).writeStream.format("memory").queryName("records").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        ends = time.time() + 60  # a pending timeout keeps the query busy, so it never is done
        while spark.table("records").count() < 5 and time.time() < ends:
            time.sleep(0.5)
    finally:
        q.stop()
    live = {r.call: r for r in spark.table("records").collect()}
    for k in "abcde":
        assert tuple(live[k]) == tuple(got[k])
