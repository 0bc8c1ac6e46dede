"""Log files, trees and records: tails by byte, rewrites, chains, incomplete marks, lost pieces; formats as columns; state that expires."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracelume import schema
from tracelume.functions import text
from tracelume.operators import maintain, objects, tree
from tracelume.sources import log
from tracelume.streaming import stream

BY_NAME = {"duration": (text.duration, text.duration_text), "tokens": (text.tokens, text.tokens_text), "size": (text.size, text.size_text), "rate": (text.rate, text.rate_text)}


@pytest.mark.parametrize("name", BY_NAME)
def test_formats_as_columns(spark, name):
    r = random.Random(6)
    plain, column = BY_NAME[name]
    whole = [0, 1, 999, 1000, 1023, 1024, 9_999, 10_000, 59_999, 60_000, 99_949, 99_950, 999_499, 999_500, 3_599_999, 3_600_000, 1_048_064, 10**7, 2**30, 5 * 2**30]
    values = whole + [125 * k for k in range(1, 90)] + [r.randrange(10 ** r.randint(1, 10)) for _ in range(400)]
    if name == "rate":
        values = [x / 8 for x in range(900)] + [r.random() * 10 ** r.randint(0, 4) for _ in range(300)] + [1.005, 2.675, 9.995, 99.95, 0.0]
    got = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").select("x", column(F.col("x")).alias("t")).collect()
    for x in got:
        want = text.DASH if x.x is None else plain(x.x if name == "rate" else int(x.x))
        assert x.t == want, x.x


def test_percent_as_column(spark):
    rows = [(1.0, 3.0), (1.0, 8.0), (0.0, 5.0), (None, 1.0), (1.0, 0.0), (1.0, None), (999.5, 1000.0)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", text.percent_text(F.col("a"), F.col("b")).alias("t")).collect()
    assert [x.t for x in got] == [text.percent(a, b) for a, b in rows]


def test_tail_reads_what_is_new(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "sub"
    b.mkdir()
    a.write_bytes('{"x":1}\n{"é":2}\n{"torn'.encode())
    (b / "b.jsonl").write_bytes(b"one\n")
    rows = lambda df: sorted((r.session_id, r.at, r.end, r.line) for r in df.collect())
    first = log.tail_bytes(spark, str(tmp_path))
    assert rows(first) == [("a", 0, 8, '{"x":1}'), ("a", 8, 17, '{"é":2}'), ("b", 0, 4, "one")]
    seen = spark.createDataFrame(first.groupBy("session_id").agg(F.max("end").alias("bytes")).collect(), "session_id string, bytes long")
    assert rows(log.tail_bytes(spark, str(tmp_path), seen)) == []
    with a.open("ab") as f:
        f.write(b'"}\nmore\n')
    (b / "b.jsonl").write_bytes(b"x\n")  # rewritten, and shorter
    assert rows(log.tail_bytes(spark, str(tmp_path), seen)) == [("a", 17, 26, '{"torn"}'), ("a", 26, 31, "more"), ("b", 0, 2, "x")]


def test_chains_to_the_longest_walk(spark):
    chain = lambda name, n: [(f"{name}{k}", f"{name}{k - 1}" if k else None, [f"{name}e{k}"]) for k in range(n)]
    nodes = chain("a", 64) + chain("b", 65) + chain("c", 1) + [("m1", "gone", ["x"]), ("y0", "y1", ["p"]), ("y1", "y0", ["q"])] + [("a0", None, ["ae0"])]
    roots = [(1, "a63"), (2, "b64"), (3, "c0"), (4, "m1"), (5, "y0"), (6, "nowhere"), (7, "a63"), (8, "a40"), (9, "b63")]
    got = tree.resolve(spark.createDataFrame(roots, "call long, hash string"), spark.createDataFrame(nodes, "hash string, parent string, entries array<string>")).collect()
    found = {r.call: r.entries for r in got}
    assert found[1] == found[7] == [f"ae{k}" for k in range(64)] and found[8] == [f"ae{k}" for k in range(41)] and found[3] == ["ce0"] and found[9] == [f"be{k}" for k in range(64)]
    assert all(found[k] is None for k in (2, 4, 5, 6)) and len(got) == 9


def test_incomplete_marks_collect_nothing(spark):
    objects_ = spark.createDataFrame([("a", 10, 0), ("b", 20, 0), ("z", 40, 0)], "hash string, bytes long, mtime_ms long")
    whole = spark.createDataFrame([("a", "b"), ("b", None)], "hash string, parent string")
    ranks, packed = spark.createDataFrame([("a", 1), ("b", 2)], "hash string, rank long"), spark.createDataFrame([("p", "a", 10), ("p", "z", 40)], "pack string, hash string, bytes long")
    roots = spark.createDataFrame([("a",)], "hash string")
    run = lambda nodes: {r.step: (r.rows, r.bytes) for r in maintain.sweep(objects_, roots, nodes, ranks, packed, 10**9, 10**9)["status"].collect()}
    assert run(whole) == {"live": (2, 30), "missing": (0, 0), "collect": (1, 40), "pack": (2, 30), "repack": (0, 0)}
    assert run(whole.where("hash <> 'b'")) == {"live": (2, 30), "missing": (1, 0), "collect": (0, 0), "pack": (2, 30), "repack": (0, 0)}


def test_records_with_lost_pieces(spark):
    h = {k: k * 64 for k in "abcdef"}
    envelopes = [("s", 1, "1", 2, [("s", h["a"]), ("m", h["b"]), ("m", h["c"])], None, h["d"], None), ("s", 2, "1", 3, None, h["e"], None, (0.5, 9, ["x"])), ("s", 3, "3", 3, None, h["f"], h["c"], None), ("s", 4, "4", 2, [], None, None, None)]
    e = spark.createDataFrame(envelopes, f"session_id string, pos long, id string, version int, refs array<struct<k:string,h:string>>, tree string, resp string, opts {schema.OPTIONS}")
    nodes = spark.createDataFrame([(h["e"], None, [f"s:{h['a']}", f"t:{h['b']}", f"m:{h['b']}"])], "hash string, parent string, entries array<string>")
    stored = spark.createDataFrame([(h["a"], '"A"'), (h["b"], "B"), (h["d"], "D")], "hash string, body string")
    got = {r.pos: tuple(r)[4:9] for r in objects.detail(e, nodes, stored).collect()}
    lost = f'{{"$unavailable":"{h["c"]}"}}'
    assert got == {1: ("A", None, ["B", lost], "D", False), 2: ("A", "B", ["B"], None, True), 3: (None, None, [], lost, False), 4: (None, None, [], None, True)}
    assert {r.pos: r.opts and tuple(r.opts) for r in objects.detail(e, nodes, stored).collect()} == {1: None, 2: (0.5, 9, ["x"]), 3: None, 4: None}


def test_retry_state_expires(spark, tmp_path):
    """A key that has been silent for longer than the window holds no state; one within it counts on."""
    source, day = tmp_path / "in", 86_400_000
    source.mkdir()
    schema = "session_id bigint, provider string, id bigint, pos bigint, request_hash string, status string, started_at bigint"
    calls = stream.stream_attempts(spark.readStream.schema(schema).json(str(source)), 120_000, late_ms=120_000)
    found = []
    for k, rows in enumerate([[(1, 0), (2, 0)], [(1, 60_000)], [(3, day)], [(4, day + 10)], [(1, day + 20)]]):
        df = spark.createDataFrame([(s, "p", 10 * k + s, 10 * k + s, "h", "error", 1_700_000_000_000 + at) for s, at in rows], schema)
        df.coalesce(1).write.mode("append").json(str(source))
        q = calls.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        found.append(states[-1] if states else None)
    got = {r.id: r.attempt for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 1, 2: 1, 11: 2, 23: 1, 34: 1, 41: 1}
    assert found[1] == 2 and found[-1] <= 3  # the keys of the first day are gone


def test_migrated_records_are_whole(spark):
    """A record of the first version comes back from its envelope, tree and pieces; one of the second keeps its references."""
    import json

    from tracelume.sources import migrate

    said = [{"role": "user", "content": [{"type": "text", "text": f"m{k} \\\\uD83D\\uDE00 é😀\\\\"}]} for k in range(3)]
    record = lambda k: {"schema": 1, "id": f"a{k}", "sessionId": "s", "provider": "p", "model": "m", "requestHash": f"h{k}", "attempt": 1, "reasoningEffort": "high", "timing": {"startedAt": k, "endedAt": 9}, "request": {"system": "sys", "messages": said[: k + 1], "tools": [{"name": "t"}], **({"temperature": 0.25, "maxTokens": 7, "stop": ["z", "a"]} if k else {})}, "response": {"blocks": [{"type": "text", "text": f"r{k}"}], "finish": {"kind": "stop"}, "chunkCount": 1}, "status": "ok"}
    h = {k: k * 64 for k in "abc"}
    second = {"v": 2, "id": "b", "sessionId": "s", "provider": "p", "model": "m", "requestHash": "h", "attempt": 1, "timing": {"startedAt": 5}, "status": "ok", "sum": {"messageCount": 1}, "opts": {"maxTokens": 3}, "refs": [{"k": "s", "h": h["a"], "z": 3}, {"k": "m", "h": h["b"], "z": 4}, {"k": "r", "h": h["c"], "z": 5}]}
    lines = spark.createDataFrame([("s", k, json.dumps(x, separators=(",", ":"), ensure_ascii=False)) for k, x in enumerate([record(0), record(1), record(2), second])] + [("s", 4, "{broken")], "session_id string, pos long, line string")
    moved, stored, nodes = migrate.migrate(lines, 1)
    before, after = (sorted(map(tuple, log.calls(x).drop("line_bytes", "object_bytes", "version").collect()), key=str) for x in (lines, moved))
    assert before == after and len(after) == 4
    assert all(json.loads(r.line)["v"] == 3 for r in moved.collect()) and json.loads(moved.where("pos = 1").first().line)["reasoningEffort"] == "high"
    said_of = lambda x: {hashlib.sha256(json.dumps(y, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for y in x}
    mine = {r.hash for r in stored.where("k <> 'n'").collect()}
    assert mine == said_of(["sys", [{"name": "t"}], *said, *[record(k)["response"] for k in range(3)]])  # as the writer hashed them
    assert {r.hash for r in tree.read_nodes(stored).collect()} == {r.hash for r in nodes.collect()} == {r.hash for r in stored.where("k = 'n'").collect()}
    pieces = stored.select("hash", "body").union(spark.createDataFrame([(h["a"], "A"), (h["b"], "B"), (h["c"], "C")], "hash string, body string"))
    got = {r.id: r for r in objects.detail(log.envelopes(moved), nodes, pieces).collect()}
    for k in range(3):
        r = got[f"a{k}"]
        assert r.complete and r.system == "sys" and json.loads(r.tools) == [{"name": "t"}] and [json.loads(m) for m in r.messages] == said[: k + 1]
        assert json.loads(r.response) == record(k)["response"]
        assert r.opts is None if not k else tuple(r.opts) == (0.25, 7, ["z", "a"])
    assert tuple(got["b"])[4:9] == ("A", None, ["B"], "C", True) and tuple(got["b"].opts) == (None, 3, None)


def test_migration_reads_its_lines_twice(spark):
    """Once for the first appearances of pieces and once for the records, which are joined with those only; the list projection reads them once."""
    from tracelume.sources import migrate

    lines = spark.createDataFrame([("s", 0, "{}")], "session_id string, pos long, line string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan()
    moved = plan(migrate.migrate(lines)[0])
    assert moved.collectLeaves().size() == 2 and moved.toString().count("Join ") == 1
    assert plan(log.calls(lines)).collectLeaves().size() == 1


def test_a_line_of_two_versions_is_of_the_later(spark):
    """``v`` is looked at first; an envelope that is not sound is no record of the first version either."""
    import json

    both = {"schema": 1, "v": 2, "id": "a", "sum": {"messageCount": 4}, "refs": [{"k": "m", "h": "0" * 64, "z": 5}], "request": {"messages": []}}
    lines = spark.createDataFrame([("s", 0, json.dumps(both)), ("s", 1, json.dumps(both | {"refs": None}))], "session_id string, pos long, line string")
    assert [(r.pos, r.version, r.message_count, r.object_bytes) for r in log.calls(lines).collect()] == [(0, 2, 4, 5)]


def test_points_for_a_width():
    from tracelume.operators import decimate

    assert [decimate.points_for(w) for w in (0, 100, 160, 161, 401)] == [80, 80, 80, 81, 201]


def test_a_node_hashes_to_its_key(spark):
    """Hashes follow from each other along a chain, and what is stored reads back."""
    h = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    lists, want, last = [], {}, None
    sizes = [1, 2, 2, 3, 5, 6, 7, 8, 2, 3, 3]
    for k, n in enumerate(sizes):
        entries = [f"{'sm'[x > 0]}:{h(x)}" for x in range(n)]
        lists.append(("s", k, entries))
        grows = last is not None and entries[: len(last[0])] == last[0]
        if grows and len(entries) == len(last[0]):
            want[k] = last[1]
            continue
        delta = grows and last[2] < 3
        own = entries[len(last[0]) :] if delta else entries
        said = '{"t":3' + (f',"p":"{last[1]}"' if delta else "") + ',"e":[' + ",".join(f'{{"k":"{x[0]}","h":"{x[2:]}"}}' for x in own) + "]}"
        last = (entries, hashlib.sha256(said.encode()).hexdigest(), last[2] + 1 if delta else 0)
        want[k] = last[1]
    built = tree.build_nodes(spark.createDataFrame(lists, "session_id string, pos long, entries array<string>"), 3)
    assert {r.pos: r.hash for r in built.collect()} == want
    stored = tree.stored_nodes(built)
    assert stored.count() == len(set(want.values()))
    back = tree.resolve(built.select(F.col("pos").alias("call"), "hash"), tree.read_nodes(stored))
    assert {r.call: r.entries for r in back.collect()} == {k: e for _, k, e in lists}
    broken = stored.withColumn("body", F.when(F.col("hash") == want[0], "{}").otherwise(F.col("body")))
    assert tree.read_nodes(broken).count() == stored.count() - 1


def test_one_chain_is_read_alone(spark, tmp_path):
    """Few roots walk their chains, many double; a walk over a large store reads what the chain names and writes nothing."""
    name = lambda s, k: hashlib.sha256(f"{s}/{k}".encode()).hexdigest()
    rows = [(name(s, k), name(s, k - 1) if k else None, [f"m:{s}/{k}"]) for s in range(400) for k in range(20)]
    written = spark.createDataFrame(rows, "hash string, parent string, entries array<string>").repartitionByRange(40, "hash").sortWithinPartitions("hash")
    written.write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    roots = spark.createDataFrame([(1, name(7, 19)), (2, name(9, 4)), (3, None), (4, "none")], "call long, hash string")
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    seen = len(list(tmp_path.parent.rglob("rdd-*")))
    few, many = ({r.call: r.entries for r in tree.resolve(roots, nodes, few=n).collect()} for n in (64, 0))
    assert few == many == {1: [f"m:7/{k}" for k in range(20)], 2: [f"m:9/{k}" for k in range(5)], 3: None, 4: None}
    assert before is not None or seen == len(list(tmp_path.parent.rglob("rdd-*")))
    chain = tree._walked(roots.where("hash is not null"), nodes, 64)
    assert chain.count() == 20 + 5 + 1
    plan = nodes.where(F.col("hash").isin([name(7, 19)]))
    assert "PushedFilters: [In" in plan._jdf.queryExecution().toString() or "EqualTo(hash" in plan._jdf.queryExecution().toString()


def test_reached_by_doubling(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(100)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    nodes = spark.createDataFrame(rows, "hash string, parent string")
    got = lambda *r: {x.hash for x in tree.reachable(spark.createDataFrame([(h,) for h in r], "hash string"), nodes).collect()}
    assert got("n99") == {f"n{k}" for k in range(100)} and got("n3", "x", "z", None) == {"n0", "n1", "n2", "n3", "x", "y", "z", "gone"} and got("alone") == {"alone"}


def test_packing_takes_what_reaches_the_budget(spark):
    o = spark.createDataFrame([(f"o{k}", 10, 0) for k in range(6)], "hash string, bytes long, mtime_ms long")
    live, ranks = o.select("hash"), spark.createDataFrame([(f"o{k}", k + 1) for k in range(6)], "hash string, rank long")
    took = lambda budget: sorted(r.hash for r in maintain.pack_candidates(o, live, ranks, 1, budget).collect())
    assert [len(took(b)) for b in (0, 5, 10, 11, 25, 60, 99)] == [1, 1, 1, 2, 3, 6, 6]
    entries = spark.createDataFrame([("small", f"o{k}", 10) for k in range(4)] + [("small", f"d{k}", 10) for k in range(6)] + [("half", f"o{k}", 10) for k in range(3)] + [("half", f"d{k}", 10) for k in range(3)], "pack string, hash string, bytes long")
    assert [r.pack for r in maintain.repack_candidates(entries, live).collect()] == ["small"]


def test_failures_are_redacted(spark):
    said = '{"message":"Incorrect API key provided: sk-abcdefgh12345678","code":"401","status":401}'
    rows = [("a", 0, 1, "finish", None, None, "error", said), ("a", 1, 2, "end", None, None, None, None), ("b", 0, 1, "finish", None, None, "error", "Bearer abcdefghijkl"), ("c", 0, 1, "x", None, None, None, None)]
    got = {r.call: r.failure for r in stream.fold_chunks(spark.createDataFrame(rows, stream.CHUNKS)).collect()}
    assert got["a"] == '{"message":"Incorrect API key provided: <redacted>","code":"401","status":401}' and got["b"] == "<redacted>"
    assert got["c"] == '{"message":"stream closed before finish","code":"ABORTED"}'


def test_many_calls_are_looked_up(spark):
    from tracelume import service
    from tracelume.plans import log_queries

    calls = spark.createDataFrame([(1, 7, 5), (1, 7, 3), (1, 8, 4), (2, 7, 9)], "session_id long, id long, pos long")
    wanted = spark.createDataFrame([(1, 7), (2, 7), (2, 9), (1, 7)], "session_id long, id long")
    assert sorted(map(tuple, service.get_calls(calls, wanted).collect())) == [(1, 7, 3), (2, 7, 9)]
    sf = "/root/testdata/sf0.001"
    assert log_queries.call_lookup(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
